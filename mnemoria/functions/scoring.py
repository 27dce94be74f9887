"""Heat, forgetting, activation, expiry, momentum and the composite rank, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400
PIN_IMPORTANCE = 0.9

# Lifetime of a layer in days; layers not listed never expire.
LAYER_TTL_DAYS = {"learning": 365, "implementation": 90, "context": 30, "emotion": 14}

# Forgetting thresholds.
COMPRESS_RISK = 50.0
DROP_RISK = 200.0

# Activation decay exponent, logistic centre and scale, access window.
DECAY_EXPONENT = 0.5
LOGISTIC_CENTRE = -6.0
LOGISTIC_SCALE = 1.5
ACCESS_WINDOW = 50

# Composite weights.
W_RELEVANCE, W_HEAT, W_MOMENTUM, W_IMPORTANCE = 0.45, 0.25, 0.15, 0.15
NEUTRAL_RELEVANCE = 0.5


def days_since(ts: Column, as_of: int) -> Column:
    return (F.lit(as_of) - ts) / F.lit(float(DAY))


def heat_score(access_count: Column, last_accessed: Column, importance: Column, as_of: int) -> Column:
    days = days_since(last_accessed, as_of)
    n = access_count.cast("double")
    month = F.least(F.when(days < 30, n).otherwise(0.0) * 3, F.lit(30.0))
    quarter = F.least(F.when(days < 90, n).otherwise(0.0), F.lit(20.0))
    recency = F.when(days <= 7, 20.0).when(days <= 30, 10.0).when(days <= 90, 0.0).otherwise(-10.0)
    tenure = F.least(n * 0.5, F.lit(15.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), month + quarter + recency + tenure + importance * 15))


def heat_band(score: Column) -> Column:
    return F.when(score >= 70, "hot").when(score >= 40, "warm").when(score >= 20, "cold").otherwise("frozen")


def forgetting_risk(heat: Column, importance: Column, days: Column, protected: Column, layer: Column) -> Column:
    open_risk = (1 - heat / 100) * (1 - importance) * days * (1 + days / 30)
    return F.when(protected | (layer == "goal"), 0.0).otherwise(open_risk)


def forgetting_action(risk: Column) -> Column:
    return F.when(risk >= DROP_RISK, "drop").when(risk >= COMPRESS_RISK, "compress").otherwise("keep")


def default_expiry(layer: Column, created: Column) -> Column:
    days = F.lit(None).cast("bigint")
    for name, n in LAYER_TTL_DAYS.items():
        days = F.when(layer == name, F.lit(n).cast("bigint")).otherwise(days)
    return created + days * DAY


def ttl_penalty(expires: Column, as_of: int) -> Column:
    overdue = days_since(expires, as_of)
    return F.when(expires.isNull() | (expires > as_of), 1.0).otherwise(F.greatest(F.lit(0.05), F.exp(-overdue / 14)))


def activation_from_strength(strength_sum: Column) -> Column:
    """Logistic of ln(sum of age^-d); a sum of zero (no accesses at all) gives 0."""
    logit = (F.ln(strength_sum) - LOGISTIC_CENTRE) / LOGISTIC_SCALE
    return F.when(strength_sum > 0, 1 / (1 + F.exp(-logit))).otherwise(0.0)


def access_strength(age_seconds: Column) -> Column:
    return F.pow(F.greatest(F.lit(1.0), age_seconds.cast("double")), F.lit(-DECAY_EXPONENT))


def momentum_parts(e24: Column, e7: Column, total: Column, age_days: Column, avg_importance: Column) -> dict[str, Column]:
    velocity = F.when(e24 >= 3, 10.0).when(e24 >= 1, 7.0).when(e7 >= 3, 4.0).when(e7 >= 1, 2.0).otherwise(0.0)
    weekly = total / age_days * 7
    ratio = e7 / weekly
    volume = (
        F.when(weekly > 0, F.when(ratio >= 3, 10.0).when(ratio >= 2, 7.0).when(ratio >= 1, 4.0).otherwise(ratio * 4))
        .when(e7 > 0, 5.0)
        .otherwise(0.0)
    )
    quality = F.least(F.lit(10.0), avg_importance * 10)
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), quality * 0.4 + velocity * 0.3 + volume * 0.3))
    return {"quality": quality, "velocity": velocity, "relative_volume": volume, "momentum": score}


def momentum_band(score: Column) -> Column:
    return F.when(score >= 7, "surging").when(score >= 4, "active").when(score >= 1.5, "quiet").otherwise("dormant")


def composite(
    relevance: Column, heat: Column, momentum: Column, importance: Column,
    activation: Column, ttl: Column, supersession: Column, ignore_decay: bool = False,
) -> Column:
    base = (
        W_RELEVANCE * relevance
        + W_HEAT * (heat / 100)
        + W_MOMENTUM * F.least(F.lit(1.0), F.coalesce(momentum, F.lit(0.0)) / 10)
        + W_IMPORTANCE * importance
    )
    if ignore_decay:
        return base
    one = F.lit(1.0)
    return base * F.coalesce(activation, one) * F.coalesce(ttl, one) * F.coalesce(supersession, one)


def linear_relevance(text: Column, vector: Column, vector_weight: float) -> Column:
    """Weighted mix of two normalised scores; a single one as it is; neither gives the neutral value."""
    w = min(1.0, max(0.0, vector_weight))
    return F.coalesce(text * (1 - w) + vector * w, text, vector, F.lit(NEUTRAL_RELEVANCE))


def min_max(value: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(value.isNotNull() & (span < 1e-6), 1.0).otherwise((value - low) / span)

"""Reports over a store: entities, momentum, edits, status and fixed views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.functions import scoring, text
from mnemoria.operators.ingest import stale_vectors
from mnemoria.operators.joins import memory_entity_view


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def entity_overview(
    entities: DataFrame, memories: DataFrame, kind: str | None = None, min_memories: int = 1, limit: int = 30, offset: int = 0
) -> DataFrame:
    """Entities with their memory counts; those without memories stay, unless a minimum is asked for.

    Memories are aggregated per entity before the join, so a huge entity is one row in it.
    """
    owners = entities if kind is None else entities.filter(F.col("kind") == kind)
    layer = F.col("layer")
    per_entity = memories.groupBy(F.col("entity_id").alias("id")).agg(
        F.count("*").alias("memory_count"),
        F.max("last_accessed_at").alias("last_memory_access"),
        _count_if(layer == "goal").alias("goal_count"),
        _count_if(layer == "realize").alias("realize_count"),
        _count_if(layer == "learning").alias("learning_count"),
        _count_if(layer == "implementation").alias("implementation_count"),
        _count_if(F.col("importance") >= scoring.PIN_IMPORTANCE).alias("pinned_count"),
    )
    counts = [c for c in per_entity.columns if c.endswith("_count")]
    joined = owners.select("id", "name", "kind", "momentum_score").join(per_entity, "id", "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
    if min_memories > 1:
        joined = joined.filter(F.col("memory_count") >= min_memories)
    score = (
        F.coalesce("momentum_score", F.lit(0.0)) * 10
        + F.col("memory_count") * 0.5
        + F.col("last_memory_access") / 86400.0 / 365 * 2
    )
    ordered = joined.withColumn("score", F.round(score, 6)).orderBy(F.col("score").desc_nulls_last(), "id")
    page = ordered.limit(limit + offset)
    return (page.offset(offset) if offset else page).select(
        "id", "name", "kind", F.round("momentum_score", 2).alias("momentum"), "memory_count", "last_memory_access",
        "goal_count", "realize_count", "learning_count", "implementation_count", "pinned_count",
    )


def entity_total(entities: DataFrame, kind: str | None = None) -> DataFrame:
    owners = entities if kind is None else entities.filter(F.col("kind") == kind)
    return owners.agg(F.count("*").alias("total"))


def store_stats(
    entities: DataFrame, memories: DataFrame, edits: DataFrame, consolidations: DataFrame, events: DataFrame
) -> DataFrame:
    """One row of totals. Each table is aggregated once; the one-row results are merged."""
    parts = [
        entities.agg(F.count("*").alias("entities")),
        memories.agg(
            F.count("*").alias("memories"),
            _count_if(F.col("importance") >= scoring.PIN_IMPORTANCE).alias("pinned"),
            _count_if(F.col("protected")).alias("protected"),
            F.min("created_at").alias("oldest"),
            F.max("created_at").alias("newest"),
        ),
        edits.agg(F.count("*").alias("file_edits")),
        # Distinct values first, so that a file or session with most of the edits is one row.
        edits.select("file_path").distinct().agg(F.count("*").alias("unique_files")),
        edits.select("session_id").distinct().agg(F.count("*").alias("sessions_seen")),
        consolidations.select("learning_id").distinct().agg(F.count("*").alias("consolidations")),
        events.agg(F.count("*").alias("events")),
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def layer_kind_breakdown(memories: DataFrame, entities: DataFrame) -> DataFrame:
    layers = memories.groupBy(F.lit("layer").alias("dimension"), F.col("layer").alias("value")).agg(F.count("*").alias("n"))
    kinds = entities.groupBy(F.lit("kind").alias("dimension"), F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    return layers.unionByName(kinds)


def top_entities(entities: DataFrame, memories: DataFrame, n: int = 10) -> DataFrame:
    counts = memories.groupBy(F.col("entity_id").alias("id")).agg(
        F.count("*").alias("memory_count"), F.max("last_accessed_at").alias("last_access")
    )
    joined = entities.select("id", "name", "kind", "momentum_score").join(counts, "id", "left")
    joined = joined.withColumn("memory_count", F.coalesce("memory_count", F.lit(0)).cast("bigint"))
    return (
        joined.orderBy(F.desc("memory_count"), F.desc("momentum_score"), "id")
        .limit(n)
        .select("id", "name", "kind", F.round("momentum_score", 2).alias("momentum"), "memory_count", "last_access")
    )


def top_files(edits: DataFrame, n: int = 5, operations: tuple[str, ...] = ("edit", "write")) -> DataFrame:
    changed = edits.filter(F.col("operation").isin(*operations))
    # Counted per (path, session) first: the distinct count needs no second pass over a hot path.
    per_session = changed.groupBy("file_path", "session_id").agg(F.count("*").alias("n"))
    return (
        per_session.groupBy("file_path")
        .agg(F.sum("n").alias("edits"), F.count("session_id").alias("in_sessions"))
        .orderBy(F.desc("edits"), "file_path")
        .limit(n)
    )


def path_matches(substring: str) -> Column:
    needle = substring.strip()
    if not needle:
        raise ValueError("a path substring is required")
    return F.lower("file_path").contains(needle.lower())


def file_edit_summary(edits: DataFrame, substring: str) -> DataFrame:
    per_session = edits.filter(path_matches(substring)).groupBy("session_id").agg(
        F.count("*").alias("n"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last")
    )
    return per_session.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_edits"),
        F.min("first").alias("first_edit_at"),
        F.max("last").alias("last_edit_at"),
        F.count("session_id").alias("sessions_involved"),
    )


def file_edit_daily(edits: DataFrame, substring: str) -> DataFrame:
    from mnemoria.functions.text import utc_day

    return edits.filter(path_matches(substring)).groupBy(utc_day(F.col("occurred_at")).alias("day"), "operation").agg(
        F.count("*").alias("edits")
    )


def file_edit_intents(edits: DataFrame, substring: str, n: int = 10) -> DataFrame:
    said = edits.filter(path_matches(substring) & (F.char_length("context_snippet") > 20))
    grouped = said.groupBy(F.col("context_snippet").alias("intent")).agg(
        F.max("occurred_at").alias("last_at"), F.count("*").alias("occurrences")
    )
    return grouped.orderBy(F.desc("last_at"), "intent").limit(max(1, min(50, n)))


def file_edit_paths(edits: DataFrame, substring: str) -> DataFrame:
    return edits.filter(path_matches(substring)).groupBy("file_path").agg(F.count("*").alias("edits"))


def entity_momentum(entities: DataFrame, events: DataFrame, memories: DataFrame, as_of: int) -> DataFrame:
    day, week = as_of - scoring.DAY, as_of - 7 * scoring.DAY
    at = F.col("occurred_at")
    activity = events.filter(F.col("entity_id").isNotNull()).groupBy(F.col("entity_id").alias("id")).agg(
        _count_if(at >= day).alias("events_24h"), _count_if(at >= week).alias("events_7d"), F.count("*").alias("events_all")
    )
    recent = (
        memories.filter(F.col("created_at") >= week)
        .groupBy(F.col("entity_id").alias("id"))
        .agg(F.avg("importance").alias("avg_importance"))
    )
    joined = entities.select("id", "created_at").join(activity, "id", "left").join(recent, "id", "left")
    for name in ("events_24h", "events_7d", "events_all"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    age = F.when(
        F.col("created_at") > 0, F.greatest(F.lit(1.0), scoring.days_since(F.col("created_at"), as_of))
    ).otherwise(1.0)
    parts = scoring.momentum_parts(
        F.col("events_24h"), F.col("events_7d"), F.col("events_all"), age, F.coalesce("avg_importance", F.lit(0.5))
    )
    scored = joined.select("id", "events_24h", "events_7d", "events_all", *[F.round(v, 6).alias(k) for k, v in parts.items()])
    return scored.withColumn("momentum_band", scoring.momentum_band(F.col("momentum")))


def refresh_momentum(entities: DataFrame, events: DataFrame, memories: DataFrame, as_of: int, stale_after: int = 3600) -> DataFrame:
    """Entities with a recomputed momentum where the stored one is older than ``stale_after`` seconds."""
    due = F.col("momentum_at").isNull() | (F.col("momentum_at") < as_of - stale_after)
    fresh = entity_momentum(entities.filter(due), events, memories, as_of).select("id", F.col("momentum").alias("__new"))
    return (
        entities.join(fresh, "id", "left")
        .withColumn("momentum_score", F.coalesce("__new", "momentum_score"))
        .withColumn("momentum_at", F.when(F.col("__new").isNotNull(), F.lit(as_of).cast("bigint")).otherwise(F.col("momentum_at")))
        .select(entities.columns)
    )


def embedding_status_report(memories: DataFrame, model: str, dim: int) -> DataFrame:
    """(item, n): active rows per embedding status, unsearchable rows, and tokenised or not."""
    active = memories.filter(F.col("archived_at").isNull())
    tokenised = F.col("content_tokenized").isNotNull()
    counted = active.groupBy("embedding_status").agg(
        F.count("*").alias("rows"),
        _count_if(stale_vectors(model, dim)).alias("stale"),
        _count_if(tokenised).alias("tokenized"),
        _count_if(~tokenised).alias("untokenized"),
    )
    # From here on there is one row per status.
    items = F.array(
        F.struct(F.concat(F.lit("status:"), "embedding_status").alias("item"), F.col("rows").alias("n")),
        *[F.struct(F.lit(name).alias("item"), F.col(name).alias("n")) for name in ("stale", "tokenized", "untokenized")],
    )
    return counted.select(F.explode(items).alias("i")).groupBy("i.item").agg(F.sum("i.n").alias("n"))


VIEW_COLUMNS = [
    "id", "entity_name", "entity_kind", "layer", "importance", "pinned", "content", "created_at", "last_accessed_at",
    "access_count",
]


def _view(rows: DataFrame, entities: DataFrame) -> DataFrame:
    joined = memory_entity_view(rows, entities)
    pinned = F.col("protected") | (F.col("importance") >= scoring.PIN_IMPORTANCE)
    return joined.withColumn("pinned", pinned).select(*VIEW_COLUMNS)


def view_hot(memories: DataFrame, entities: DataFrame) -> DataFrame:
    accessed = memories.filter(F.col("last_accessed_at").isNotNull())
    return _view(accessed.orderBy(F.desc("access_count"), F.desc("last_accessed_at"), "id").limit(50), entities)


def view_recent(memories: DataFrame, entities: DataFrame, as_of: int) -> DataFrame:
    recent = memories.filter(F.col("last_accessed_at") >= as_of - 7 * scoring.DAY)
    return _view(recent.orderBy(F.desc("last_accessed_at"), "id").limit(50), entities)


def view_realizes(memories: DataFrame, entities: DataFrame) -> DataFrame:
    rows = _view(memories.filter(F.col("layer") == "realize"), entities)
    return rows.orderBy(F.desc("importance"), F.desc("created_at"), "id")


def view_entity(memories: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    owner = entities.filter(F.lower("name") == name.lower())
    return _view(memories, owner).orderBy(F.desc("importance"), F.desc("created_at"), "id")


def view_layer(memories: DataFrame, entities: DataFrame, layer: str) -> DataFrame:
    named = text.LAYER_ALIASES.get(layer.strip().lower())
    if named is None:
        raise ValueError(f"unknown layer {layer!r}")
    rows = memories.filter(F.col("layer") == named)
    return _view(rows.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(200), entities)

"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests tells from prose.

DataFrame operations only. One scan stores every match with the length of the text before it; places, tests and the
control of false discoveries then work on matches alone.

A token counts as a secret if (a) no test of the battery on its inferred encoding (chi-squared uniformity over the
alphabet, runs about the middle of the alphabet, lag-1 serial correlation) rejects randomness, and (b) it is a
discovery against prose: the number of changes between letter case, digits and signs, the index of coincidence of its
folded symbols, and a hexadecimal token's letters each give a p-value under prose; combined by Fisher's method, they
enter a Benjamini-Hochberg procedure within each length band of all tokens. Short tokens need stronger evidence, as they have less of it.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.llm.common import documents, stored, text_or_empty

# The base patterns. A match is dropped if its measured group is shorter than the length given.
PATTERNS = {
    "assign": (
        r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
    "random": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Encodings, the narrowest first.
ALPHABETS = [
    DIGITS, DIGITS + LOWER[:6], DIGITS + UPPER[:6], UPPER + DIGITS[2:8], LOWER + DIGITS[2:8], LOWER + DIGITS, UPPER + DIGITS,
    BASE58, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_",
]


@dataclass(frozen=True)
class Settings:
    #: Two-sided bound for each test of the battery, in standard deviations (about 0.001).
    most_deviation: float = 3.29
    #: Prose: index of coincidence of English letters, and changes of symbol class per step.
    prose_coincidence: float = 0.066
    prose_changes: float = 0.1
    #: Share of prose letters that are also hexadecimal digits.
    prose_hex_letters: float = 0.32
    false_discoveries: float = 0.01


def bound(value: Column, use) -> Column:
    """``use`` applied to ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, kind: str) -> Column:
    """Matches of a kind, kept or not, as (before, length, measured, token): lengths in code points."""
    pattern, group, _ = PATTERNS[kind]

    def parts(found: Column) -> Column:
        before = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        measured = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
        token = found if kind == "random" else F.transform(found, lambda x: F.lit(""))
        rows = F.arrays_zip(before.alias("before"), found.alias("found"), measured.alias("measured"), token.alias("token"))
        return F.transform(
            F.slice(rows, 1, F.size(found)),
            lambda x: F.struct(
                x["before"].alias("before"), F.length(x["found"]).alias("length"),
                F.length(x["measured"]).alias("measured"), x["token"].alias("token"),
            ),
        )

    empty = F.expr("cast(array() AS array<struct<before:int,length:int,measured:int,token:string>>)")
    return bound(
        F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, empty).otherwise(parts(found))
    )


def placed(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, token) of the matches that are long enough; code points, end exclusive."""
    each = functools.reduce(
        DataFrame.unionByName,
        [rows.select("row", F.lit(i).alias("kind"), F.posexplode(kind).alias("place", "m")) for i, kind in enumerate(KINDS)],
    )
    before = W.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("m.before").cast("long") + F.col("m.length")).over(before)
    least = F.element_at(F.array(*[F.lit(PATTERNS[k][2]) for k in KINDS]), F.col("kind") + 1)
    return (
        each.withColumn("end", end).where(F.col("m.measured") >= least)
        .select("row", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end", F.col("m.token").alias("token"))
    )


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, within one per cent at any distance (Borjesson and Sundberg)."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / (
        (1 - 1 / math.pi) * x + 1 / math.pi * F.sqrt(x * x + 2 * math.pi)
    )
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame, settings: Settings) -> DataFrame:
    """``tokens`` with ``symbols`` (without padding), ``random`` (no test rejects) and ``p`` (against prose)."""
    rows = tokens.withColumn("symbols", F.regexp_replace("token", "=+$", ""))
    n = F.length("symbols").cast("double")
    fits = F.coalesce(
        *[F.when(F.length(F.translate("symbols", a, "")) == 0, F.lit(a)) for a in ALPHABETS]
    )
    rows = rows.withColumn("alphabet", fits)
    k = F.length("alphabet").cast("double")

    def sum_of_squares(text: str) -> Column:
        chars = F.array_distinct(F.split(text, ""))
        length = F.length(text)
        squares = F.transform(chars, lambda c: F.pow((length - F.length(F.replace(F.col(text), c, F.lit("")))).cast("double"), F.lit(2.0)))
        return F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)

    values = F.transform(F.split("symbols", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    rows = rows.withColumns({"n": n, "k": k}).withColumns(
        {
            "chi": F.col("k") / F.col("n") * sum_of_squares("symbols") - F.col("n"),
            "values": values,
            "folded": F.lower("symbols"),
            # One letter per symbol class; runs of it then shrink to one letter each.
            "classes": F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
                "symbols", "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s"),
        }
    )
    df = F.col("k") - 1
    uniform = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    rows = rows.withColumn(
        "halves", F.array_join(F.transform("values", lambda v: F.when(2 * v > F.col("k"), "1").otherwise("0")), "")
    )
    high = F.length(F.replace("halves", F.lit("0"), F.lit(""))).cast("double")
    rows = rows.withColumns({"high": high, "runs": F.length(F.regexp_replace("halves", r"(.)\1*", "$1")).cast("double")})
    both = 2 * F.col("high") * (F.col("n") - F.col("high"))
    spread = both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    runs = F.when(spread > 0, (F.col("runs") - both / F.col("n") - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))
    rows = rows.withColumn("mean", F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    shifted = F.transform("values", lambda v: v - F.col("mean"))
    rows = rows.withColumn("off", shifted)
    length = F.size("off")
    lagged = F.aggregate(
        F.zip_with(F.slice("off", F.lit(1), length - 1), F.slice("off", F.lit(2), length - 1), lambda a, b: a * b),
        F.lit(0.0), lambda a, x: a + x,
    )
    scale = F.aggregate("off", F.lit(0.0), lambda a, x: a + x * x)
    serial = F.when(scale > 0, (lagged / scale + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(99.0))
    limit = settings.most_deviation
    number = F.col("alphabet") == DIGITS  # plain numbers are no keys
    random = ~number & (F.abs(uniform) < limit) & (F.abs(runs) < limit) & (F.abs(serial) < limit)

    # Against prose. Changes of class: Chernoff's bound of a Poisson tail. Coincidence: a normal lower tail.
    changes = (F.length(F.regexp_replace("classes", r"(.)\1*", "$1")) - 1).cast("double")
    expected = settings.prose_changes * (F.col("n") - 1)
    p_changes = F.when(changes <= expected, F.lit(0.0)).otherwise(changes - expected - changes * F.log(changes / expected))
    pairs = F.col("n") * (F.col("n") - 1)
    coincidence = (sum_of_squares("folded") - F.col("n")) / pairs
    q = settings.prose_coincidence
    p_coincidence = F.log(upper_tail((q - coincidence) / F.sqrt(2 * q / pairs)))
    letters = F.length(F.regexp_replace("symbols", "[^A-Za-z]", ""))
    p_letters = F.when(F.col("k") == 16, letters * math.log(settings.prose_hex_letters)).otherwise(0.0)
    joint = F.least(p_changes + p_coincidence + p_letters, F.lit(0.0))  # log of the product of the p-values
    p = F.exp(F.greatest(joint + F.log(1 - joint + joint * joint / 2), F.lit(-600.0)))
    return rows.withColumns({"random": F.coalesce(random, F.lit(False)), "p": F.coalesce(p, F.lit(1.0))})


def discoveries(tests: DataFrame, settings: Settings) -> DataFrame:
    """The tokens of ``tests`` that are random and pass Benjamini-Hochberg within their length band.

    The procedure works on counts of p-values in steps of a twentieth of a power of ten: a few thousand rows a band,
    and as many bands as a length has binary digits.
    """
    step = 20
    rows = tests.withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn(
        "bin", F.floor(-F.log10(F.when(F.col("random"), F.col("p")).otherwise(1.0)) * step).cast("int")
    )
    counts = rows.groupBy("band", "bin").agg(F.count("*").alias("c"))
    from_best = W.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("c").over(from_best)).withColumn("all", F.sum("c").over(W.partitionBy("band")))
    passed = F.pow(F.lit(10.0), -F.col("bin") / step) <= settings.false_discoveries * F.col("rank") / F.col("all")
    least = ranked.where(passed & (F.col("bin") > 0)).groupBy("band").agg(F.min("bin").alias("least"))
    return rows.join(F.broadcast(least), "band").where(F.col("random") & (F.col("bin") >= F.col("least")))


def scan(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of ``docs``: rows (row, doc_id), one per input row; spans (row, kind, start, end), kind an index of KINDS.

    Null texts count as empty. Every pattern is searched in the whole text, leftmost and without overlap within a
    kind. A token that the tests find is left out where a base span covers it.
    """
    whole = text_or_empty(text)
    narrow = docs.select("doc_id", whole.alias("__text"))
    rows = stored(
        narrow.select("doc_id", *[matches(F.col("__text"), kind).alias(kind) for kind in KINDS])
        .withColumn("row", F.monotonically_increasing_id()),
        "secret-matches",
    )
    found = stored(placed(rows), "secret-places")
    base = found.where(F.col("kind") < len(BASE))
    tokens = stored(battery(found.where(F.col("kind") == len(BASE)), settings), "secret-tests")
    extra = discoveries(tokens, settings).select("row", "kind", "start", "end")
    both = base.select("row", "kind", "start", "end").unionByName(extra)
    earlier = W.partitionBy("row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = F.max(F.when(F.col("kind") < len(BASE), F.col("end"))).over(earlier)
    spans = both.withColumn("covered", covered).where(
        (F.col("kind") < len(BASE)) | F.col("covered").isNull() | (F.col("covered") < F.col("end"))
    ).drop("covered")
    return rows.select("row", "doc_id"), spans


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows, spans = scan(documents(spark, sf_dir))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    as_text = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    listed = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.struct("start", "kind", as_text.alias("s")))).alias("all"),
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: x["s"]), ",")

    listed = listed.withColumns(
        {"base": joined(F.filter("all", lambda x: x["kind"] < len(BASE))), "spans": joined(F.col("all"))}
    ).drop("all")
    return rows.join(listed, "row", "left").select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{kind}"), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.coalesce(F.col("base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.col("spans"), F.lit("")).alias("spans"),
    )

"""Near-duplicates by SetSketch registers over sets of shingles.

A register holds the truncated logarithm, to a base just above 1, of the least of exponential hashes of a set's elements: a
sketch of a union is the larger of the registers one by one, and two sets agree in a register about as often as their similarity
tells. Documents that agree in all registers of a band are candidates. How often one register is above, below and equal to the
other's gives, with the sizes of the sets, a likelihood of their similarity; where the threshold is far less likely than the
best similarity, the pair goes. The others are compared on their whole sets, so that every link is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.llm.common import documents, ship_package, stored
from mnemoria.llm.components import classes_in_buckets
from mnemoria.llm.simhash import shingle_hashes

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    #: Words in a shingle.
    words: int = 4
    #: The least similarity of a link as a fraction, so that the comparison is one of whole numbers.
    least: tuple[int, int] = (4, 5)
    #: At 0.8, two sets agree in no band with a probability of (1 - 0.8 ** 5) ** 40, about 1e-7.
    bands: int = 40
    band: int = 5
    #: Base of the logarithm and rate of the hashes; registers have 16 bits.
    base: float = 1.001
    rate: float = 20.0
    #: A pair goes if the threshold is less likely than the best similarity by this many natural logarithms (six deviations).
    most_unlikely: float = 18.0
    seed: int = 42

    @property
    def registers(self) -> int:
        return self.bands * self.band

    @property
    def threshold(self) -> float:
        return self.least[0] / self.least[1]


def least_hashes(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """Per register, the least of the different ``hashes`` under the register's own mixing."""
    factors = np.random.default_rng(settings.seed).integers(0, 2**64, settings.registers, np.uint64) | _U(1)
    out = np.full(settings.registers, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(out, (hashes[at : at + 512, None] * factors).min(axis=0), out=out)
    return out


def registers(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    """The sketch of a set of hashes, as numbers of 16 bits; zeros for the empty set."""
    if not len(hashes):
        return np.zeros(settings.registers, dtype=np.uint16)
    share = (least_hashes(hashes, settings).astype(np.float64) + 0.5) / 2.0**64
    # -log(1 - share) is exponential if share is uniform, and grows with it, so the least of one is the least of the other.
    exponential = -np.log1p(-np.minimum(share, 1 - 2.0**-53)) / settings.rate
    return np.clip(np.floor(1 - np.log(exponential) / np.log(settings.base)), 0, 2**16 - 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: bytes, settings: Settings) -> list[int]:
    """A hash per band of registers, as signed numbers."""
    import xxhash

    width = 2 * settings.band
    keys = [xxhash.xxh64_intdigest(sketch[at : at + width], at) for at in range(0, len(sketch), width)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, n: int, u: np.ndarray, v: np.ndarray, base: float) -> np.ndarray:
    """Of similarity ``j`` if, of ``n`` registers, so many of the first set's are above and below the second's; u and v are the
    sets' shares of the sum of their sizes."""

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (base - 1) / base) / np.log(base)

    up, down = chance(u - v * j), chance(v - u * j)
    equal = np.maximum(1 - up - down, 1e-300)
    up, down = np.maximum(up, 1e-300), np.maximum(down, 1e-300)
    return above * np.log(up) + below * np.log(down) + (n - above - below) * np.log(equal)


def similarity(above: np.ndarray, below: np.ndarray, n: int, u: np.ndarray, v: np.ndarray, base: float) -> np.ndarray:
    """The most likely similarity, by sections of the interval that the sizes allow (the logarithm is concave)."""
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        a, b = low + third, high - third
        better = log_likelihood(a, above, below, n, u, v, base) < log_likelihood(b, above, below, n, u, v, base)
        low, high = np.where(better, a, low), np.where(better, high, b)
    return (low + high) / 2


def may_link(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series, settings: Settings) -> np.ndarray:
    """Whether the threshold, or more, is likely enough from two columns of sketches and set sizes."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    x, y = (np.frombuffer(b"".join(c), dtype=np.uint16).reshape(len(c), -1) for c in (a, b))
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    n_a, n_b = size_a.to_numpy(np.float64), size_b.to_numpy(np.float64)
    u, v, n = n_a / (n_a + n_b), n_b / (n_a + n_b), settings.registers
    best = similarity(above, below, n, u, v, settings.base)
    at_best = log_likelihood(best, above, below, n, u, v, settings.base)
    limit = np.minimum(settings.threshold, np.minimum(u / v, v / u))
    at_limit = log_likelihood(limit, above, below, n, u, v, settings.base)
    return (best >= limit) | (at_best - at_limit <= settings.most_unlikely)


def with_sketches(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """``docs`` with ``digests`` (two, equal for equal sets), ``n_shingles`` and ``sketch`` (bytes) of the whole text."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("digests array<bigint>, n_shingles bigint, sketch binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            rows = []
            for whole in texts:
                found = np.unique(shingle_hashes(whole, settings.words, settings.seed))
                raw = found.tobytes()
                pair = np.array([xxhash.xxh64_intdigest(raw, settings.seed + i) for i in (0, 1)], dtype=np.uint64).view(np.int64)
                rows.append((pair.tolist(), len(found), registers(found, settings).tobytes()))
            yield pd.DataFrame(rows, columns=["digests", "n_shingles", "sketch"])

    return docs.withColumn("__sketch", sketched(F.col(text))).select(*docs.columns, "__sketch.*")


def linked_nodes(nodes: DataFrame, docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(node, root) of the ``nodes`` (node, n_shingles, sketch, of: a document's id and mark) that have a link."""
    over, under = settings.least

    @F.pandas_udf("array<bigint>")
    def keys(sketches: pd.Series) -> pd.Series:
        return sketches.map(lambda x: band_keys(x, settings))

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
        return pd.Series(may_link(a, b, size_a, size_b, settings))

    @F.pandas_udf("array<bigint>")
    def shingle_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, settings.words, settings.seed)).view(np.int64).tolist() for t in texts])

    def sizes_allow(a: Column, b: Column) -> Column:
        return under * F.least(a, b) >= over * F.greatest(a, b)

    def enough(n: Column, a: Column, b: Column) -> Column:
        return (under + over) * n >= over * (a + b)

    def sets_of(wanted: DataFrame) -> DataFrame:
        one = nodes.join(wanted, "node").select("node", F.col("of.doc_id").alias("__id"), F.col("of.mark").alias("__mark"))
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark"))
        texts = docs.select("doc_id", text).join(one, same).select("node", F.col(text).alias("__text")).dropDuplicates(["node"])
        return stored(texts.select("node", shingle_sets("__text").alias("shingles")), "shingle-sets")

    def elements(wanted: DataFrame) -> DataFrame:
        return sets_of(wanted).select("node", F.explode("shingles").alias("element"))

    def verify(pairs: DataFrame) -> DataFrame:
        # The side with few different nodes, a bucket's smallest, is joined last: its sketch and set are not carried per pair.
        a, b = (nodes.select(F.col("node").alias(n), F.col("sketch").alias(f"sketch_{n}"), F.col("n_shingles").alias(f"size_{n}")) for n in "ab")
        told = pairs.join(b, "b").join(a, "a").where(likely("sketch_a", "sketch_b", "size_a", "size_b"))
        met = stored(told.select("a", "b"), "likely-pairs")
        sets = sets_of(met.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}")) for n in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        counted = met.join(b, "b").join(a, "a").select("a", "b", both.alias("both"), F.size("set_a").alias("all_a"), F.size("set_b").alias("all_b"))
        return counted.where(enough(F.col("both"), F.col("all_a"), F.col("all_b"))).select("a", "b")

    buckets = nodes.select(F.posexplode(keys("sketch")).alias("__band", "bucket"), "node", F.col("n_shingles").alias("payload"))
    return classes_in_buckets(buckets.drop("__band"), sizes_allow, verify, elements, enough)


def near_duplicates(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents whose sets of shingles are similar to ``least`` or more, or that a chain of such links joins, share a component, named
    by its smallest doc_id (null if no member has one); that document is kept. Repeated rows are kept or go together. Null, empty and
    wordless texts have an empty set, are linked with nothing and are kept. An empty table gives no row.
    """
    narrow = docs.select("doc_id", F.col(text).alias("__text"), F.xxhash64(text).alias("mark"))
    rows = stored(with_sketches(narrow, "__text", settings).drop("__text"), "sketches")
    # Equal digests have equal sets, so any row of them will do.
    distinct = rows.where("n_shingles > 0").groupBy("digests").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        F.min(F.struct("doc_id", "mark")).alias("of"),
    )
    # Nodes are numbered by their smallest doc_id: the first text of a group is mostly the one that the others copy.
    numbered = distinct.repartitionByRange("least").sortWithinPartitions("least", "digests")
    nodes = stored(numbered.withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    roots = linked_nodes(nodes, docs, text, settings)
    placed = nodes.select("node", "digests", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(names, "root").select("digests", "component_id"), "components")
    slim = rows.select("doc_id", "n_shingles", "digests")
    # Copies share their digests: a hot set is the skewed side of this join, which adaptive execution splits.
    told = slim.where("n_shingles > 0").join(named, "digests").select("doc_id", "n_shingles", "component_id")
    alone = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_setsketch(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM d, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

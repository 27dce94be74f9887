"""Exact duplicates by batches: static binary fuse filters screen new digests against immutable snapshots.

A snapshot holds one row per distinct digest, never changed once written, and a filter for each shard of its digests.
A new batch is first grouped by itself. Its distinct digests pass the filters of every snapshot; positives join that
snapshot's exact buckets, and digests new to all form the next snapshot. Wherever a digest occurs more than once, the
texts themselves are compared: rows that a filter of those digests lets through meet by bucket, byte for byte.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.llm import fuse
from mnemoria.llm.common import documents, ship_package, stored, text_or_empty
from mnemoria.llm.screen import BROADCAST_BYTES, filters, screened, shard_of, shards_for

# White space that does not count.
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


@dataclass(frozen=True)
class Settings:
    batches: int = 2
    #: Keys in a shard of a snapshot, and of a batch that meets it.
    shard_keys: int = 100_000
    #: The filter of repeated digests is broadcast up to this size; beyond it, rows are shuffled to its shards.
    broadcast_bytes: int = BROADCAST_BYTES
    #: Hexadecimal digits of the digest that make a bucket; fewer than all only to test the byte checks.
    bucket_digits: int = 64


@dataclass(frozen=True)
class Snapshot:
    #: (bucket, best, n): best is the row that stays, as (points, ~doc_id, ~row).
    groups: DataFrame
    #: (shard, filter)
    filters: DataFrame
    shards: int


def normalised(text: Column | str) -> Column:
    return functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text_or_empty(text))


def key(bucket: str = "bucket") -> Column:
    return F.xxhash64(bucket)


def snapshot(groups: DataFrame, settings: Settings) -> Snapshot:
    shards = shards_for(groups.count(), settings.shard_keys)
    return Snapshot(groups, filters(groups.select(key().alias("key")), shards), shards)


def screened_by_shard(rows: DataFrame, held: DataFrame, shards: int, count: int, settings: Settings) -> DataFrame:
    """``rows`` (distinct ``bucket``) of which a filter in ``held`` may hold the bucket.

    Rows meet their shard's filter in groups of bounded size: a large batch is cut further, each part with its own
    copy of the filter.
    """
    parts = max(1, -(-count // (shards * settings.shard_keys)))
    part = F.pmod(F.xxhash64("bucket", F.lit("part")), F.lit(parts)).cast("int")
    left = rows.select("bucket", shard_of(key(), shards).alias("shard"), key().alias("key"), part.alias("part"))
    right = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def kept(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or own.empty:
            return pd.DataFrame({"bucket": pd.Series(dtype=object)})
        return pdf.loc[fuse.contains(own["filter"].iloc[0], pdf["key"].to_numpy().view(np.uint64)), ["bucket"]]

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(kept, "bucket string")


def grouped(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("doc"), F.bitwise_not("row").alias("row")))
    return rows.groupBy("bucket").agg(best.alias("best"), F.count("*").alias("n"))


def absorbed(batch: DataFrame, snapshots: list[Snapshot], settings: Settings) -> tuple[Snapshot, list[DataFrame]]:
    """The snapshot of a batch's digests that are new, and the groups that join earlier snapshots' buckets."""
    groups = stored(grouped(batch), "batch-groups")
    count = groups.count()
    joined = []
    for old in snapshots:
        maybe = screened_by_shard(groups, old.filters, old.shards, count, settings)
        exact = maybe.join(old.groups.select("bucket"), "bucket", "left_semi")
        joined.append(stored(groups.join(exact, "bucket", "left_semi"), "batch-known"))
    fresh = groups
    for known in joined:
        fresh = fresh.join(known.select("bucket"), "bucket", "left_anti")
    return snapshot(stored(fresh, "batch-new") if joined else groups, settings), joined


def disputed(docs: DataFrame, repeated: DataFrame, text: str, settings: Settings) -> DataFrame:
    """Buckets of ``repeated`` whose texts are not all the same bytes (with whole SHA-256 digests: none expected).

    Each task keeps at most two texts a bucket, so copies of one text do not travel.
    """
    rows = docs.select(normalised(text).alias("norm")).withColumn("bucket", bucket(F.col("norm"), settings))
    rows = screened(rows, key(), stored(repeated.select(key().alias("key")), "repeated"), settings.broadcast_bytes)
    ends = rows.groupBy("bucket").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("bucket")
    return stored(ends.join(repeated, "bucket", "left_semi"), "disputed")


def bucket(norm: Column, settings: Settings) -> Column:
    return F.substring(F.sha2(norm, 256), 1, settings.bucket_digits)


def deduplicated(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; null counts as empty. Of equal texts the one with the most
    code points stays, then the smallest doc_id (null last), then one of the repeated rows. The rows are taken in as
    ``settings.batches`` batches by a hash of the id.
    """
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", F.col(text).alias("__text"))
    rows = stored(taken_in(docs, settings), "digests")
    snapshots: list[Snapshot] = []
    parts: list[DataFrame] = []
    for i in range(settings.batches):
        batch = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(settings.batches)) == i)
        new, known = absorbed(batch, snapshots, settings)
        snapshots.append(new)
        parts += [new.groups, *known]
    together = functools.reduce(DataFrame.unionByName, parts)
    classes = stored(
        together.groupBy("bucket").agg(F.max("best").alias("best"), F.sum("n").alias("n")), "classes"
    )
    wrong = disputed(docs, classes.where("n > 1").select("bucket"), "__text", settings)
    if wrong.isEmpty():
        return told(rows, classes)
    # Same digest, other bytes: these rows are grouped by their texts instead.
    texts = taken_in(docs, settings, keep_norm=True).join(wrong, "bucket", "left_semi")
    texts = stored(texts.withColumn("bucket", F.concat_ws(":", "bucket", "norm")).drop("norm"), "disputed-texts")
    return told(rows.join(wrong, "bucket", "left_anti"), classes).unionByName(told(texts, grouped(texts)))


def taken_in(docs: DataFrame, settings: Settings, keep_norm: bool = False) -> DataFrame:
    rows = docs.select(
        "doc_id", F.length(text_or_empty("__text")).alias("points"), normalised("__text").alias("norm"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("text_sha256", F.sha2("norm", 256)).withColumn("bucket", bucket(F.col("norm"), settings))
    return rows if keep_norm else rows.drop("norm")


def told(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One text may fill a third of all rows: its rows are the skewed side, which adaptive execution splits."""
    return rows.join(classes, "bucket").select(
        "doc_id", F.bitwise_not("best.doc").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.bitwise_not("best.row") == F.col("row")).alias("kept"), "text_sha256",
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

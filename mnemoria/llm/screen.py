"""Rows whose key may be in a set of keys, told where the rows lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.llm import fuse
from mnemoria.llm.common import ship_package, stored

SHARD_KEYS = 100_000
#: Filters are broadcast up to this size together, at nine bits a key.
BROADCAST_BYTES = 32 << 20


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int")


def filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of the long column ``key``: a binary fuse filter per shard of about SHARD_KEYS keys."""
    ship_package(keys.sparkSession)

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [fuse.build(pdf["key"].to_numpy().view(np.uint64))]})

    rows = keys.select(shard_of(F.col("key"), shards).alias("shard"), "key")
    return stored(rows.groupBy("shard").applyInPandas(built, "shard int, filter binary"), "fuse-filters")


def shards_for(count: int, shard_keys: int = SHARD_KEYS) -> int:
    return max(1, -(-count // shard_keys))


def screened(rows: DataFrame, key: Column, keys: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows whose ``key`` (a long) is in ``keys`` (distinct longs, column ``key``).

    Within ``most_bytes`` of filters, these are broadcast and only rows that pass them are shuffled to the exact
    keys; with more keys, all rows are.
    """
    rows = rows.withColumn("__key", key)
    shards = shards_for(keys.count())
    held = filters(keys, shards)
    size = held.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0)).alias("b")).first()["b"]
    if size <= most_bytes:
        own = rows.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in held.collect()})

        @F.pandas_udf("boolean")
        def maybe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for at, found_keys in batches:
                found, shard, values = np.zeros(len(at), dtype=bool), at.to_numpy(), found_keys.to_numpy().view(np.uint64)
                for s in np.unique(shard):
                    if s in own.value:
                        found[shard == s] = fuse.contains(own.value[s], values[shard == s])
                yield pd.Series(found)

        rows = rows.where(maybe(shard_of(F.col("__key"), shards), F.col("__key")))
    return rows.join(keys.withColumnRenamed("key", "__key"), "__key", "left_semi").drop("__key")

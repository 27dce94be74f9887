"""Words as numbers: tasks code their own words, and one dictionary renumbers the codes of all tasks.

A shard is what one task has read of up to ``SHARD_WORDS`` words (a longer text is a shard of its own). Only the different words
of a shard meet the dictionary, never single occurrences, so a word that is everywhere is one row per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of a shard, from which on a new one begins.
SHARD_WORDS = 500_000
#: Shards of one task are numbered below this.
TASK_SHARDS = 1 << 24


class Vocabulary(dict):
    """Codes of words from ``first`` on, in the order in which they are asked for."""

    def __init__(self, first: int = 0):
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) + self.first
        return code

    def strings(self) -> pa.Array:
        return pa.array(list(self), pa.binary()).cast(pa.string())


def one_list(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """An array of one row that holds all ``values``."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values).cast(pa.list_(values.type))


def packed(*numbers: np.ndarray) -> bytes:
    """Arrays as one short run of bytes. Spark holds a column of arrays many times over: each entry with its levels, and in a file's
    batches by the number of rows, however long these are."""
    return pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in numbers), codec="zstd", asbytes=True)


def unpacked(data: pa.Scalar, size: int) -> pa.Buffer:
    """The ``size`` bytes of ``packed`` arrays, read from a row."""
    return pa.decompress(data.as_buffer(), decompressed_size=size, codec="zstd")


def shard_number(task: int, shard: int) -> int:
    return task * TASK_SHARDS + shard


def global_codes(shards: DataFrame, dictionary: DataFrame, on: list[str]) -> DataFrame:
    """(shard, locals, codes): for each shard, places in its ``words`` and codes of those that ``dictionary`` (``on``, code) has.

    ``shards`` has (shard, words) and the columns of ``on`` other than ``word``. Both lists are as long as a shard's words at most.
    """
    more = [c for c in on if c != "word"]
    each = shards.select("shard", *more, F.posexplode("words").alias("local", "word"))
    pairs = each.join(dictionary.select(*on, "code"), on).groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct("local", "code"))).alias("pairs")
    )
    return pairs.select("shard", F.col("pairs.local").alias("locals"), F.col("pairs.code").alias("codes"))

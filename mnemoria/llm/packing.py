"""Packing into length buckets: bounds that minimise padding, and batches of a token budget inside each bucket.

Documents longer than the longest sequence are cut into pieces of that length. A dynamic program over the histogram of all
piece lengths (at most as many rows as the longest sequence) finds the bounds; a piece is padded to the bound of its
bucket. A batch holds as many pieces of a bucket as fit the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from mnemoria.llm.common import documents, hash_share, stored
from mnemoria.llm.token_counts import count_tokens

#: Above any padding; sums with one stay within 64 bits.
NEVER = 1 << 61


@dataclass(frozen=True)
class Settings:
    longest: int = 2048
    buckets: int = 8
    batch_tokens: int = 32_768
    #: Pieces numbered together in one task, on average.
    slice_rows: int = 4096
    seed: int = 23


def bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over lengths with ``counts``, with the least padding in total.

    best[j], for one bucket more each round, is the least padding of the lengths up to the j-th, the last bucket ending there.
    A later end never wants an earlier start, so the starts of one round are found by halves: n log n steps and n memory.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    held = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
    n, total = np.concatenate([[0], np.cumsum(held)]), np.concatenate([[0], np.cumsum(held * lengths)])

    def cost(first: np.ndarray | int, last: int) -> np.ndarray | int:
        return lengths[last] * (n[last + 1] - n[first]) - (total[last + 1] - total[first])

    best = np.array([cost(0, j) for j in range(len(lengths))], dtype=np.int64)
    chosen = []
    for _ in range(min(buckets, len(lengths)) - 1):
        start, after = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), NEVER)
        open_ranges = [(1, len(lengths) - 1, 1, len(lengths) - 1)]
        while open_ranges:
            low, high, least, most = open_ranges.pop()
            if low > high:
                continue
            end = (low + high) // 2
            first = np.arange(least, min(end, most) + 1)
            whole = best[first - 1] + cost(first, end)
            at = int(whole.argmin())
            start[end], after[end] = first[at], whole[at]
            open_ranges += [(low, end - 1, least, int(first[at])), (end + 1, high, int(first[at]), most)]
        chosen.append(start)
        best = after
    out, at = [int(lengths[-1])], len(lengths) - 1
    for start in reversed(chosen):
        at = int(start[at]) - 1
        if at < 0:
            break
        out.append(int(lengths[at]))
    return sorted(out)


def pieces(lengths: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, piece, start, n_tokens): rows of (doc_id, length) cut at the longest sequence; an empty one has one piece of 0."""
    last = F.greatest(F.ceil(F.col("length") / settings.longest) - 1, F.lit(0)).cast("long")
    cut = lengths.select("doc_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * settings.longest
    return cut.select(
        "doc_id", "piece", start.alias("start"), F.least(F.col("length") - start, F.lit(settings.longest)).cast("long").alias("n_tokens")
    )


def packed(lengths: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Place rows of (doc_id, length in tokens): doc_id, piece, start, n_tokens, bucket, batch, slot.

    ``bucket`` is the length that a piece is padded to; ``batch`` numbers a bucket's batches from 0, each of
    ``batch_tokens // bucket`` pieces (the last may hold fewer), ``slot`` the pieces in a batch. Documents without a token take
    no place: bucket 0, batch and slot null. Null lengths count as 0. The order within a bucket is fixed by a hash of the
    row; repeated rows take a place each.
    """
    rows = stored(pieces(lengths.select("doc_id", F.coalesce("length", F.lit(0)).alias("length")), settings), "pieces")
    histogram = rows.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n"))
    ends = bounds({r["n_tokens"]: r["n"] for r in histogram.collect()}, settings.buckets)
    if not ends:
        bucket = F.lit(0).cast("long")
    else:
        bucket = F.when(F.col("n_tokens") == 0, 0)
        for end in ends:
            bucket = bucket.when(F.col("n_tokens") <= end, end)
        bucket = bucket.cast("long")
    told = rows.withColumn("bucket", bucket)
    full = told.where("bucket > 0")
    # A bucket's pieces are numbered in slices of bounded size, each after the sum of those before it.
    sizes = full.groupBy(F.col("bucket").alias("b")).agg(F.ceil(F.count("*") / settings.slice_rows).alias("slices"))
    drawn = hash_share("doc_id", "piece", "n_tokens", F.lit(settings.seed))
    sliced = full.join(F.broadcast(sizes), F.col("bucket") == F.col("b")).select(  # as many rows as buckets
        *told.columns, drawn.alias("drawn"), F.floor(drawn * F.col("slices")).cast("long").alias("slice")
    )
    counts = sliced.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(counts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    place = F.row_number().over(W.partitionBy("bucket", "slice").orderBy("drawn", "doc_id", "piece")) - 1
    numbered = sliced.withColumn("place", place).join(offsets, ["bucket", "slice"])
    at = F.col("offset") + F.col("place")
    capacity = F.greatest(F.floor(F.lit(settings.batch_tokens) / F.greatest("bucket", F.lit(1))), F.lit(1)).cast("long")
    out = numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket",
        F.floor(at / capacity).cast("long").alias("batch"), (at % capacity).cast("long").alias("slot"),
    )
    none = F.lit(None).cast("long")
    return out.unionByName(told.where("bucket = 0").withColumns({"batch": none, "slot": none}))


def packed_documents(docs: DataFrame, settings: Settings = Settings(), model: str | None = None) -> DataFrame:
    """``packed`` by the tokens of whole texts (null: none) under a vocabulary file; ``start`` counts tokens."""
    return packed(count_tokens(docs.select("doc_id", "text"), model=model, out="length").select("doc_id", "length"), settings)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))

"""Building blocks that keep any single key, however large, out of a single task."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.runtime import ship_package, stored

CHUNK_ROWS = 4096
RIGHT_ROWS_BOUND = 4096
RIGHT_BYTES_BOUND = 64 << 20


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b: longs); root is the smallest node of its component.

    Each round points every node to its smallest neighbour, follows the pointers twice, and renames the links by them;
    links within one name go. The links at least halve per round, and no node's links ever meet in one place.
    """
    edges = stored(
        links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b").distinct(),
        "links",
    )
    labels = None
    while labels is None or not edges.isEmpty():
        first = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "parents")
        above = first.select(F.col("node").alias("up"), F.col("up").alias("next"))
        # Every pointer leads to a node that has links itself, so the join keeps all rows.
        parents = stored(first.join(above, "up").select("node", F.col("next").alias("up")), "parents-next")
        if labels is None:
            labels = parents.select("node", F.col("up").alias("root"))
        else:
            renamed = parents.select(F.col("node").alias("root"), "up")
            labels = labels.join(renamed, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        labels = stored(labels, "labels")
        a, b = parents.select(F.col("node").alias("a"), F.col("up").alias("x")), parents.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = stored(
            edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
            "links",
        )
    return labels


def spread(scan: DataFrame, *key: str) -> DataFrame:
    """A plain file scan on at least as many tasks as there are cores.

    A few small files make a few tasks, which leaves cores idle under expensive text work. Only
    then are rows moved, by a unique key; a scan with enough splits, as any large table has, is
    left in place.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *key)


def global_positions(df: DataFrame, order: list[Column | str], name: str = "pos", start: int = 0) -> DataFrame:
    """Add the 0-based position (plus ``start``) of every row in the total order ``order``.

    The order must be unique. Rows are range-partitioned, sorted and written, one file per partition; a row's position
    is its place in its file plus the rows of the files before. No window over the whole table and no unbounded
    group is involved.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), "ordered")
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    placed = ordered.select("*", number.alias("__part"), F.col("_metadata.row_index").alias("__row"))
    # One row per partition: thousands at most, whatever the data size.
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + F.col("__row") + F.lit(start))
        .drop("__part", "__row", "__offset")
    )


def carry_forward(df: DataFrame, keys: list[str], seq: str, value: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``name``: the last non-null ``value`` at or before each row of the same ``keys``.

    ``seq`` is an integer order that is unique within ``keys``. A key is cut into chunks of
    ``chunk_rows`` positions; the window runs inside a chunk, and only one summary row per chunk
    takes part in the window over the whole key.
    """
    parts = [*keys, "__chunk"]
    chunked = df.withColumn("__chunk", F.floor(F.col(seq) / F.lit(chunk_rows)))
    summary = chunked.groupBy(*parts).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(seq))).alias("__last")
    )
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    entering = summary.select(*parts, F.last("__last", ignorenulls=True).over(earlier).alias("__enter"))
    inside = W.partitionBy(*parts).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    local = chunked.withColumn("__local", F.last(value, ignorenulls=True).over(inside))
    return (
        local.join(entering, parts, "left")
        .withColumn(name, F.coalesce("__local", "__enter"))
        .drop("__chunk", "__local", "__enter")
    )


def blocked_product(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[Iterator[pd.DataFrame], pd.DataFrame], Iterator[pd.DataFrame]],
    schema: str,
    right_key: str,
    right_rows: int = RIGHT_ROWS_BOUND,
    right_bytes: int = RIGHT_BYTES_BOUND,
) -> DataFrame:
    """Score every ``left`` row against every ``right`` row without forming the pairs as rows.

    ``kernel`` gets the left rows of a task as batches and a block of right rows, and yields only the hits worth keeping (a
    local top-k or the rows over a threshold). The right side is cut by the hash of its unique key into blocks of at
    most about ``right_rows`` rows and ``right_bytes`` bytes. One block after another is broadcast, and the left side
    streams past it where it lies; it is never shuffled, and read once per block.
    """
    ship_package(left.sparkSession)

    def against(shared: Broadcast) -> DataFrame:
        return left.mapInPandas(lambda batches: kernel(batches, shared.value), schema)

    return in_blocks(right, right_key, against, right_rows, right_bytes)


def in_blocks(
    right: DataFrame, right_key: str, against: Callable[[Broadcast], DataFrame],
    right_rows: int = RIGHT_ROWS_BOUND, right_bytes: int = RIGHT_BYTES_BOUND,
) -> DataFrame:
    """The union of ``against(block)`` over blocks of ``right``, each broadcast as a pandas frame of bounded size."""
    spark = right.sparkSession
    right = stored(right, "queries")
    size = functools.reduce(lambda a, b: a + b, [_bytes(c) for c in right.dtypes])
    found = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-found["n"] // right_rows), -(-int(found["bytes"]) // right_bytes))
    part = F.pmod(F.xxhash64(right_key), F.lit(blocks))
    shared = [spark.sparkContext.broadcast(right.where(part == i).toPandas()) for i in range(blocks)]
    return functools.reduce(DataFrame.unionByName, [against(block) for block in shared])


def _bytes(column: tuple[str, str]) -> Column:
    name, kind = column
    if kind == "string":
        return F.coalesce(F.octet_length(name), F.lit(0))
    if kind == "array<string>":
        return F.coalesce(F.octet_length(F.array_join(name, " ")), F.lit(0)) + 8
    if kind.startswith("array"):
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.size(name) * F.lit(8))
    if kind.startswith(("struct", "map")):
        return F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return F.lit(8)

"""The skew-safe building blocks against their plain forms."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from mnemoria.scale import blocked_product, carry_forward, connected, global_positions, spread


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(5, 3), (3, 5), (9, 9), (8, 2), (2, 7)], []])
def test_connected(spark, links):
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_global_positions_are_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("g").alias("g"))
    placed = global_positions(df, ["g", "x"], "pos", 10)
    assert [(r.x, r.pos) for r in placed.orderBy("x").collect()] == [(i, i + 10) for i in range(5000)]
    assert global_positions(df.limit(0), ["g", "x"]).count() == 0


def test_carry_forward_crosses_chunks(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("k"), F.col("id").alias("seq"), F.when(F.col("id") % 170 == 1, F.col("id")).alias("v")
    )
    got = carry_forward(df, ["k"], "seq", "v", "last", chunk_rows=13)
    window = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("last", F.last("v", ignorenulls=True).over(window))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("bound", [1000, 7])
def test_blocked_product_same_hits_either_way(spark, bound):
    left = spark.range(300).select("id")
    right = spark.range(30).select(F.col("id").alias("q"))

    def kernel(batches, block):
        for pdf in batches:
            pairs = pdf.merge(block, how="cross")
            yield pairs[pairs["id"] % (pairs["q"] + 2) == 0][["id", "q"]]

    hits = blocked_product(left, right, kernel, "id bigint, q bigint", "q", right_rows=bound)
    assert {tuple(r) for r in hits.collect()} == {(i, q) for i in range(300) for q in range(30) if i % (q + 2) == 0}
    assert hits.count() == len({tuple(r) for r in hits.collect()})


def test_spread_only_moves_small_scans(spark, tmp_path):
    pd.DataFrame({"id": range(10)}).to_parquet(tmp_path / "one.parquet")
    scan = spark.read.parquet(str(tmp_path))
    assert spread(scan, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 16)
    assert spread(many, "id") is many

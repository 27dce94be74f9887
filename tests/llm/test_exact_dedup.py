"""Binary fuse filters, and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pytest

from mnemoria.llm import exact_dedup, fuse

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 2, 17, 1000, 50_000])
def test_filters_hold_all_keys(n):
    rng = np.random.default_rng(n)
    keys, others = (rng.integers(0, 2**63, size, dtype=np.uint64) for size in (n, 20_000))
    built = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(built, keys).all()
    assert fuse.contains(built, others).mean() < 0.01
    assert n < 1000 or len(built) * 8 < 12 * n


def by_hand(rows):
    groups = {}
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), i is None, i or 0))
    out = []
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])
        out.append((i, None if best[1] else best[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def check(df, rows):
    got = df.collect()
    want, groups = by_hand(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    assert sum(r.kept for r in got) == groups and all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
def test_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(exact_dedup.op3_exact_dedup(spark, SF), rows)


ODD = [(i, f"t{i % 23}" + " " * (i % 5)) for i in range(200)] + [
    (500, None), (501, ""), (502, " \n\t"), (503, " "), (504, "long " * 40000), (505, "long" * 40000),
    (7, "t7  "), (7, "t7  "), (None, "t7"), (None, "only"), (None, "only")]


def test_odd_rows(spark, table):
    check(exact_dedup.op3_exact_dedup(spark, table(ODD)), ODD)
    assert exact_dedup.op3_exact_dedup(spark, table([])).count() == 0
    clash = spark.createDataFrame([(1, "a b", 1), (2, "ab", 2)], "doc_id long, text string, bucket int")
    assert [r.keep_id for r in exact_dedup.deduplicated(clash).collect()] == [1, 1]


@pytest.mark.parametrize("settings", [
    exact_dedup.Settings(batches=3, shard_keys=5), exact_dedup.Settings(bucket_digits=1),
    exact_dedup.Settings(broadcast_bytes=0), exact_dedup.Settings(batches=1),
])
def test_shards_batches_and_byte_checks(spark, table, settings):
    docs = spark.read.parquet(f"{table(ODD)}/documents.parquet")
    check(exact_dedup.deduplicated(docs, settings=settings), ODD)

"""Bucket bounds against all choices; places and batches; the pipeline stage by stage."""

from __future__ import annotations

import collections
import itertools
import os
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from mnemoria.llm import packing

SF = "/root/testdata/sf0.001"


def padding(counts, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in counts.items())


@pytest.mark.parametrize("seed", range(5))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    counts = {x: rng.randint(1, 9) for x in rng.sample(range(1, 40), 9)}
    for k in (1, 2, 3, 4, 9, 20):
        got = packing.bounds(counts, k)
        assert len(got) <= k and got[-1] == max(counts)
        want = min(padding(counts, [*some, max(counts)]) for some in itertools.combinations(sorted(counts), min(k, len(counts)) - 1))
        assert padding(counts, got) == want
    assert packing.bounds({}, 3) == []


def test_bounds_of_a_long_histogram_equal_the_whole_matrix():
    rng = random.Random(9)
    counts = {x: rng.choice([1, 3, 10**9, 10**10]) for x in range(1, 700) if rng.random() < 0.8}
    lengths = sorted(counts)
    cost = {}
    for i in range(len(lengths)):
        held = inside = 0
        for j in range(i, len(lengths)):
            held, inside = held + counts[lengths[j]], inside + counts[lengths[j]] * lengths[j]
            cost[i, j] = held * lengths[j] - inside
    best = [cost[0, j] for j in range(len(lengths))]
    for _ in range(5):
        best = [min([best[j]] + [best[i - 1] + cost[i, j] for i in range(1, j + 1)]) for j in range(len(lengths))]
    assert padding(counts, packing.bounds(counts, 6)) == best[-1]


def test_texts_without_spaces_are_cut(spark, table):
    texts = [(1, "東京都の天気は晴れです。" * 900), (2, "aGVsbG8gd29ybGQ" * 700), (3, "two words"), (4, ""), (5, None), (3, "two words")]
    got = packing.op8_packing(spark, table(texts)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    check(got, [(i, len(library.encode(t or ""))) for i, t in texts], packing.Settings())
    assert all(sum(r.doc_id == i for r in got) > 1 for i in (1, 2)) and max(r.n_tokens for r in got) == 2048


def check(rows, lengths, settings):
    by_doc = collections.defaultdict(list)
    places = set()
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bucket:
            assert 0 < r.n_tokens <= r.bucket <= settings.longest
            assert 0 <= r.slot < max(1, settings.batch_tokens // r.bucket)
            assert (r.bucket, r.batch, r.slot) not in places
            places.add((r.bucket, r.batch, r.slot))
        else:
            assert r.n_tokens == 0 and r.batch is None and r.slot is None
    wanted = collections.Counter(i for i, _ in lengths)
    for i, n in lengths:
        own = sorted(by_doc[i], key=lambda r: r.start)
        if wanted[i] == 1:
            assert sum(r.n_tokens for r in own) == (n or 0)
            assert [r.start for r in own] == [settings.longest * k for k in range(len(own))]
    # Batches are numbered without gaps, and all but a bucket's last are full.
    for bucket in {r.bucket for r in rows if r.bucket}:
        held = collections.Counter(r.batch for r in rows if r.bucket == bucket)
        assert sorted(held) == list(range(len(held)))
        assert all(held[b] == max(1, settings.batch_tokens // bucket) for b in held if b < len(held) - 1)


def test_places(spark):
    rng = random.Random(6)
    lengths = [(i, min(5000, int(rng.paretovariate(0.6) * 3))) for i in range(500)]
    lengths += [(600, 0), (601, None), (602, 64), (602, 64), (None, 10), (None, 700)]
    settings = packing.Settings(longest=64, buckets=5, batch_tokens=200, slice_rows=40)
    docs = spark.createDataFrame(lengths, "doc_id long, length long")
    got = packing.packed(docs, settings).collect()
    check(got, lengths, settings)
    counts = collections.Counter(r.n_tokens for r in got if r.n_tokens)
    assert sorted({r.bucket for r in got if r.bucket}) == packing.bounds(counts, 5)
    again = packing.packed(docs.repartition(7), settings).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.packed(docs.limit(0), settings).count() == 0
    assert [r.bucket for r in packing.packed(docs.where("doc_id = 600"), settings).collect()] == [0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
def test_op8_and_the_pipeline_over_a_table(spark, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    lengths = [(i, len(library.encode(t or ""))) for i, t in texts.items()]
    check(packing.op8_packing(spark, SF).collect(), lengths, packing.Settings())

    docs, columns, kept = spark.read.parquet(f"{SF}/documents.parquet"), None, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
        assert after.columns == columns and {r.doc_id for r in after.collect()} <= kept and after.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    total = sum(len(library.encode(r.text or "")) for r in docs.collect())
    assert sum(r.n_tokens for r in last) == total


def test_pipeline_on_odd_and_empty_tables(spark, table):
    words = "the cat sat on a mat with other cats and talked about dogs for hours until night fell over town".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=30)) + f"\nline {i}", "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(100, None), (101, "", "en"), (102, "123"), (None, "the cat without a number sat down quietly", None, None), rows[3], rows[3]]
    rows += [(200, rows[5][1], "en", "a", 1)]
    got = corpus_pipeline.run(spark, table(rows)).collect()
    assert got and {r.doc_id for r in got}.isdisjoint({100, 101, 102, 200})
    assert corpus_pipeline.run(spark, table([])).count() == 0


def test_stages_keep_extra_columns_with_clashing_names(spark, table):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa".split(), k=25)) + f" number {i}",
             "en", "ab"[i % 2], 1) for i in range(30)]
    docs = spark.read.parquet(f"{table(rows)}/documents.parquet").selectExpr(
        "*", "1 AS mark", "2 AS lines", "3 AS root", "4 AS lanes", "5 AS node", "'x' AS lang_pred", "0.5 AS SCORE", "6 AS rejected",
        "7 AS bucket", "8 AS class", "9 AS no", "10 AS length")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert sorted(c.lower() for c in out.columns) == sorted(c.lower() for c in docs.columns), name
        assert 0 < out.count() and set(out.select("node", "class").distinct().collect()) == {(5, 8)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 30

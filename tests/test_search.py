"""Search and recall against brute force, on both sides of the broadcast bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemoria.functions.vectors import cosine
from mnemoria.model import make_store
from mnemoria.operators import recall, search, text_index
from mnemoria.runtime import stored
from tests.conftest import DAY, NOW

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def corpus(memories, n=120):
    rng = np.random.default_rng(7)
    out = []
    for i in range(n):
        words = rng.choice(WORDS, size=rng.integers(1, 12), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])
        body = " ".join(words)
        vec = rng.normal(size=2).tolist() if i % 7 else [0.0, 0.0]
        out.append({"content": body, "content_tokenized": body, "embedding": vec, "importance": (i % 9) / 10,
                    "layer": ["context", "learning"][i % 2], "entity_id": 1 + i % 2,
                    "archived_at": 5 if i % 10 == 0 else None})
    return memories(*out), out


@pytest.mark.parametrize("bound", [4096, 2])
def test_bm25_equals_brute_force(memories, queries, bound):
    m, rows = corpus(memories)
    asked = [("alpha zeta", None), ("theta theta beta", None), ("gamma", "learning"), ("missing", None), ("eta", None)]
    q = queries(*[{"text": t, "layer": layer} for t, layer in asked])
    got = {(r.query_id, r.id): (r.bm25, r.fts_rank) for r in search.bm25_search(q, m, 50, right_rows=bound).collect()}
    lists = [r["content"].split() for r in rows]
    mean = sum(map(len, lists)) / len(lists)
    want = {}
    for qi, (t, layer) in enumerate(asked):
        scored = []
        for i, words in enumerate(lists):
            s = 0.0
            for term in t.split():
                df = sum(term in w for w in lists)
                tf = words.count(term)
                if tf:
                    idf = math.log((len(lists) - df + 0.5) / (df + 0.5))
                    s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if s > 0 and rows[i]["archived_at"] is None and layer in (None, rows[i]["layer"]):
                scored.append((-round(s, 9), i + 1))
        for rank, (s, row_id) in enumerate(sorted(scored)[:50], 1):
            want[(str(qi), row_id)] = (-s, rank)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-8) for k in want)


ASKED = [("alpha zeta", None), ("theta theta beta", None), ("gamma", "learning"), ("missing", None), ("eta", None), ("", None)]


@pytest.mark.parametrize("flags", [{}, {"include_archived": True}, {"include_superseded": True},
                                   {"include_archived": True, "include_superseded": True}])
@pytest.mark.parametrize("bound", [4096, 2])
def test_an_index_gives_the_rows_of_the_scan(memories, queries, tmp_path, bound, flags):
    m, _ = corpus(memories)
    m = m.withColumn("superseded_by_id", F.when(F.col("id") % 15 == 0, 1)).withColumn("archived_at", F.when(F.col("id") % 6 == 0, 5))
    # Nulls and empty texts take part as in the scan.
    m = m.withColumn("content_tokenized", F.when(F.col("id") % 11 == 0, F.lit("")).when(F.col("id") % 13 != 0, F.col("content_tokenized")))
    q = queries(*[{"text": t, "layer": layer} for t, layer in ASKED], {"text": None}, {"text": "alpha", "entity_name": "x"})
    index = text_index.write_index(m, str(tmp_path / "index"), shard_rows=17)
    got = text_index.indexed_search(q, index, 9, right_rows=bound, **flags)
    want = search.bm25_search(q, m, 9, **flags)
    key = lambda df: sorted((r.query_id, r.fts_rank, r.id, round(r.bm25, 8)) for r in df.collect())
    assert key(got) == key(want) and want.count() > 20


def test_an_index_grows_and_follows_states(spark, memories, queries, tmp_path):
    m, _ = corpus(memories)
    q, path = queries(*[{"text": t, "layer": layer} for t, layer in ASKED]), str(tmp_path / "index")
    text_index.write_index(m.where("id <= 40"), path, shard_rows=16)
    first = {f.name for f in (tmp_path / "index" / "postings").rglob("*.parquet")}
    text_index.write_index(m.where("id > 40"), path, shard_rows=16)
    assert first < {f.name for f in (tmp_path / "index" / "postings").rglob("*.parquet")}
    index = text_index.read_index(spark, path)
    key = lambda df: sorted((r.query_id, r.fts_rank, r.id, round(r.bm25, 8)) for r in df.collect())
    assert key(text_index.indexed_search(q, index)) == key(search.bm25_search(q, m))
    assert index.rows.count() == 3 + 5
    # Postings that a failed run left behind, without rows, are not read.
    left = index.postings.limit(50).withColumn("part", F.lit("left")).select(*index.postings.columns)
    stored(left).write.mode("append").partitionBy("part", "folder").parquet(f"{path}/postings")
    assert key(text_index.indexed_search(q, text_index.read_index(spark, path))) == key(search.bm25_search(q, m))
    # Other states now; the postings are the same files.
    now = m.withColumn("archived_at", F.when(F.col("id") % 3 == 0, 7)).withColumn("layer", F.when(F.col("id") % 4 == 0, "learning").otherwise("context"))
    later = text_index.with_states(index, now)
    assert key(text_index.indexed_search(q, later)) == key(search.bm25_search(q, now))
    gone = text_index.with_states(index, now.where("id <> 2"))
    found = text_index.indexed_search(q, gone, include_archived=True, include_superseded=True)
    assert found.where("id = 2").isEmpty() and found.where("id = 3").count() > 0


def test_an_index_of_nothing(memories, queries, tmp_path):
    m, _ = corpus(memories)
    q = queries({"text": "alpha"})
    empty = text_index.write_index(m.limit(0), str(tmp_path / "empty"))
    assert text_index.indexed_search(q, empty).count() == 0
    full = text_index.write_index(m, str(tmp_path / "full"))
    assert text_index.indexed_search(q.limit(0), full).count() == 0
    assert text_index.indexed_search(queries({"text": "missing"}, {"text": None}), full).count() == 0


def test_a_search_reads_only_folders_of_its_terms(memories, queries, tmp_path):
    words = [f"word{i}" for i in range(300)]
    m = memories(*[{"content": w, "content_tokenized": f"{w} {words[i - 1]}"} for i, w in enumerate(words)])
    index = text_index.write_index(m, str(tmp_path / "index"))
    assert len(list((tmp_path / "index" / "postings").glob("part=*/folder=*"))) == text_index.FOLDERS
    hits = text_index.indexed_search(queries({"text": "word7"}), index)
    assert hits.count() == 2
    plan = hits._jdf.queryExecution().toString()
    scans = [x for x in plan.split("PartitionFilters: ")[1:] if "folder" in x.split("]")[0]]
    assert scans and all("IN" in x.split("PushedFilters")[0] or "=" in x.split("PushedFilters")[0] for x in scans)


@pytest.mark.parametrize("bound", [4096, 2])
def test_substring_equals_brute_force(memories, entities, queries, bound):
    m, rows = corpus(memories)
    e = entities({"name": "Alpha 100%"}, {"name": "Other"})
    asked = [{"text": "ALPHA beta"}, {"text": "100%"}, {"text": "ignored", "entity_name": "other"}, {"text": ""},
             {"text": "a_p"}, {"text": "zeta", "layer": "context"}]
    got = {(r.query_id, r.id): r.like_rank for r in search.substring_search(queries(*asked), m, e, 40, right_rows=bound).collect()}
    names = {1: "alpha 100%", 2: "other"}
    want = {}
    for qi, q in enumerate(asked):
        hits = []
        for i, r in enumerate(rows):
            needle = (q.get("entity_name") or q["text"]).lower()
            ok = needle in names[r["entity_id"]] or ("entity_name" not in q and needle in r["content"])
            if ok and r["archived_at"] is None and q.get("layer") in (None, r["layer"]):
                hits.append((-r["importance"], i + 1))
        want.update({(str(qi), row_id): n for n, (_, row_id) in enumerate(sorted(hits)[:40], 1)})
    assert got == want


@pytest.mark.parametrize("bound", [4096, 2])
def test_vectors_equal_cosine_expression(spark, memories, queries, bound):
    m, _ = corpus(memories)
    q = queries(*[{"text": "x", "vec": [float(i), 1.0 - i], "layer": "learning" if i == 2 else None} for i in range(5)],
                {"text": "bad", "vec": [1.0]}, {"text": "none"})
    got = {(r.query_id, r.id): r.cos for r in search.vector_search(q, m, "m", 2, 0.6, 30, right_rows=bound).collect()}
    pairs = q.filter(F.size("vec") == 2).select("query_id", "vec", F.col("layer").alias("ql")).join(
        m.filter("archived_at IS NULL"), F.col("ql").isNull() | (F.col("ql") == F.col("layer"))
    )
    scored = pairs.select("query_id", "id", cosine(F.col("vec"), F.col("embedding")).alias("cos")).filter("cos >= 0.6").toPandas()
    scored["cos"] = scored["cos"].round(6)
    top = scored.sort_values(["cos", "id"], ascending=[False, True]).groupby("query_id").head(30)
    want = {(r.query_id, r.id): r.cos for r in top.itertuples()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_merge_in_several_ways_is_the_same(spark):
    hits = spark.range(500).select(F.lit("q").alias("query_id"), "id", (F.col("id") * 37 % 101).cast("double").alias("s"))
    one, many = (search.merge_ranked(hits, 20, "r", F.desc("s"), ways=n).collect() for n in (1, 7))
    assert sorted(one) == sorted(many) and len(one) == 20


def test_embed_queries_keeps_queries_without_a_vector(spark, queries):
    q = queries({"text": "red"}, {"text": ""}, {"text": "none"}).drop("vec")

    def factory():
        return lambda texts: [None if t.endswith("none") else [float(len(t))] for t in texts]

    got = {r.query_id: r.vec for r in recall.embed_queries(q, factory).collect()}
    assert got == {"0": [10.0], "1": None, "2": None}


def test_vector_search_skips_other_models_and_pending(memories, queries):
    ok = {"embedding": [1.0, 0.0]}
    m = memories(ok, {**ok, "embedding_model": "old"}, {**ok, "embedding_status": "pending"}, {**ok, "embedding_dim": 3},
                 {**ok, "embedding": [1.0]}, {"embedding": None})
    hits = search.vector_search(queries({"text": "q", "vec": [1.0, 0.0]}), m, "m", 2).collect()
    assert [(r.id, r.vec_rank) for r in hits] == [(1, 1)]


def test_provenance_and_order(spark, memories, entities, queries):
    m = memories(
        {"content": "red fox", "content_tokenized": "red fox", "embedding": [1.0, 0.0]},
        {"content": "red fox jumps", "content_tokenized": "red fox jumps"},
        {"content": "fox", "content_tokenized": "fox"},
        {"content": "a red foxglove", "content_tokenized": None},
        {"content": "unrelated", "content_tokenized": "unrelated", "embedding": [1.0, 0.1]},
    )
    found = search.hybrid_candidates(queries({"text": "red fox", "vec": [1.0, 0.0]}), m, entities({}), "m", 2)
    assert {r.id: r.via for r in found.collect()} == {1: "vector+fts", 2: "fts+like", 3: "fts", 4: "like", 5: "vector"}


def test_recall_flags_band_and_reasons(spark, store, queries):
    base = {"content": "note on foxes", "content_tokenized": "note on foxes"}
    hot = {**base, "importance": 0.95, "access_count": 30, "last_accessed_at": NOW}
    s = store(hot, base, {**base, "archived_at": 1}, {**base, "layer": "realize", "protected": True, "activation_score": 0.1})
    q = queries({"text": "foxes"})
    hits = {r.id: r for r in recall.hybrid_recall(q, s, NOW).collect()}
    assert hits.keys() == {1, 2, 4} and hits[1]["rank"] == 1 and hits[1].band == "hot"
    assert {"content_match_dual", "content_substring", "heat:hot", "pinned"} <= set(hits[1].match_reasons)
    assert "realize_protected" in hits[4].match_reasons and hits[4].composite < hits[2].composite
    flat = {r.id: r for r in recall.hybrid_recall(q, s, NOW, recall.RecallConfig(ignore_decay=True)).collect()}
    assert flat[4].composite == pytest.approx(hits[4].composite * 10)
    only = recall.hybrid_recall(q, s, NOW, recall.RecallConfig(band="hot")).collect()
    assert [r.id for r in only] == [1] and only[0].total_candidates == 1 and not only[0].has_more
    both = recall.hybrid_recall(q, s, NOW, recall.RecallConfig(include_archived=True)).collect()
    assert "archive_explicit" in next(r for r in both if r.id == 3).match_reasons
    page = recall.hybrid_recall(q, s, NOW, recall.RecallConfig(limit=1, offset=1)).collect()
    assert [(r["rank"], r.has_more) for r in page] == [(2, True)]


def test_rerank_reorders_head_and_fails_open(spark):
    ranked = spark.createDataFrame([("q", i, "t", "c" * (9 - i), i) for i in range(1, 6)],
                                   "query_id STRING, rank INT, text STRING, content STRING, id BIGINT")

    def by_length(_, content: pd.Series) -> pd.Series:
        return -content.str.len()

    def broken(_, content):
        raise RuntimeError

    got = {r.id: r.new_rank for r in recall.rerank_top_n(ranked, by_length, 3).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {r.id: r.new_rank for r in recall.rerank_top_n(ranked, broken, 3).collect()} == {i: i for i in range(1, 6)}


def test_multi_layer_scope_and_context(spark, memories, entities, queries):
    base = {"content": "use the fox", "content_tokenized": "use the fox"}
    m = memories({**base, "layer": "realize"}, {**base, "layer": "learning", "entity_id": 2}, base)
    s = make_store(spark, memories=m, entities=entities({"name": "Alpha"}, {"name": "Beta"}))
    top = recall.multi_layer_recall(queries({"text": "fox"}), s, NOW, project="ALPHA")
    assert [(r.id, r.title) for r in top.collect()] == [(1, "Alpha / realize")]
    block = recall.recall_context(recall.multi_layer_recall(queries({"text": "fox"}), s, NOW)).first().context
    assert block.startswith("<recalled>\nNote:") and block.count("\n- [") == 2 and block.endswith("</recalled>\n")


def test_mark_accessed_counts_each_hit(spark, store):
    s = store({}, {})
    hits = spark.createDataFrame([("a", 1), ("b", 1)], "query_id STRING, id BIGINT")
    after = recall.mark_accessed(s, hits, NOW)
    assert {r.id: (r.access_count, r.last_accessed_at) for r in after.memories.collect()} == {1: (2, NOW), 2: (0, NOW - 10 * DAY)}
    assert after.access_log.count() == 2


def test_recall_quality(spark):
    cases = spark.createDataFrame([("a", "en"), ("b", "en"), ("c", "ja")], "query_id STRING, lang STRING")
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 9)], "query_id STRING, id BIGINT")
    hits = spark.createDataFrame([("a", 2, 2), ("b", 3, 7), ("c", 1, 1)], "query_id STRING, id BIGINT, rank INT")
    got = {r.subset: (r.recall_at_5, r.recall_at_10, r.mrr) for r in recall.recall_quality(cases, expected, hits).collect()}
    assert got["en"] == (0.5, 1.0, pytest.approx((0.5 + 1 / 7) / 2, abs=1e-6)) and got["ja"] == (0.0, 0.0, 0.0)
    assert got["overall"][1] == pytest.approx(2 / 3, abs=1e-6)


@pytest.mark.parametrize("layer, found", [("realize", 1), (" Warnings", 1), ("learning", 1), ("nowhere", 2), (None, 2)])
def test_a_layer_may_be_an_alias_or_unknown(memories, entities, queries, layer, found):
    vec = [1.0, 0.0]
    rows = [{"content": "needle one", "content_tokenized": "needle one", "layer": x, "embedding": vec} for x in ("realize", "learning")]
    m, e = memories(*rows), entities({})
    q = queries({"text": "needle", "layer": layer, "vec": vec})
    assert search.bm25_search(q, m).count() == found
    assert search.substring_search(q, m, e).count() == found
    assert search.vector_search(q, m, "m", 2, 0.5).count() == found


def test_json_content_is_measured_unescaped(spark, store, queries):
    body = '{"title": "a \\"quoted\\" needle",  "n": 1}'
    s = store({"content": body, "content_tokenized": "needle"}, {"content": 'plain "needle"', "content_tokenized": "needle"})
    hits = recall.hybrid_recall(queries({"text": "needle"}), s, NOW, recall.RecallConfig(max_tokens=6000))
    lengths = {r.id: (r.n, r.rest) for r in hits.select(
        "id", F.char_length(recall.serialised()).alias("n"),
        F.char_length(F.to_json(F.struct(*[c for c in recall.OUTPUT if c != "content"]))).alias("rest")).collect()}
    compact = len('{"n":1,"title":"a \\"quoted\\" needle"}')
    assert lengths[1][0] - lengths[1][1] == len(',"content":') + compact
    assert lengths[2][0] - lengths[2][1] == len(',"content":') + len('"plain \\"needle\\""')
    assert all(r.pinned is False for r in hits.collect())


def test_terms_are_counted_in_pieces():
    """A batch of many rows is not split into words as a whole."""
    import pyarrow as pa

    from mnemoria.operators.text_index import CHUNK, counted_terms

    n = 2 * CHUNK + 1
    batch = pa.RecordBatch.from_pydict({"shard": [i % 2 for i in range(n)], "id": list(range(n)), "content_tokenized": ["b a b"] * n})
    pieces = list(counted_terms([batch]))
    assert [p.num_rows for p in pieces] == [2 * CHUNK, 2 * CHUNK, 2]
    rows = [r for p in pieces for r in p.to_pylist()]
    assert sorted((r["shard"], r["id"], r["term"], r["times"]) for r in rows) == sorted(
        (i % 2, i, t, k) for i in range(n) for t, k in (("a", 1), ("b", 2))
    )

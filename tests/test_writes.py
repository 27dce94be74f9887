"""Ingest, edits, vectors, supersession, snapshots, store."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.operators import filters, ingest, reports, snapshots, supersede
from mnemoria.operators.ingest import keyword_encoder
from mnemoria.plans.maintenance import maintenance_check, maintenance_pass
from mnemoria.sources.store import load_store, replace_sessions, save_store
from tests.conftest import DAY, NOW

INCOMING = ("seq BIGINT, entity_kind STRING, entity_name STRING, entity_key STRING, layer STRING, content STRING, "
            "importance DOUBLE, expires_at BIGINT, force BOOLEAN")


def incoming(spark, *items):
    names = [p.strip().split(" ")[0] for p in INCOMING.split(",")]
    base = {"entity_kind": "project", "entity_name": "Alpha", "layer": "context", "content": "a thought"}
    return spark.createDataFrame([tuple({"seq": i, **base, **item}.get(n) for n in names) for i, item in enumerate(items)], INCOMING)


def test_ingest_checks_redacts_and_protects(spark, store):
    rows = incoming(
        spark, {"layer": "warnings"}, {"layer": "no such"}, {"content": "x" * 8001}, {"content": "● pasted"},
        {"content": "● pasted", "force": True}, {"content": "token=abc", "importance": 7.0}, {"layer": "mood"},
        {"expires_at": 42},
    )
    after, accepted, rejected = ingest.ingest_memories(rows, store({}), NOW)
    assert sorted((r.seq, r.reason) for r in rejected.collect()) == [(1, "unknown_layer"), (2, "too_long"), (3, "pasted")]
    got = [r for r in accepted.orderBy("id").collect()]
    assert [r.id for r in got] == [2, 3, 4, 5, 6]
    assert got[0].layer == "realize" and got[0].protected and got[0].expires_at is None
    assert got[2].content == "token=[REDACTED]" and got[2].importance == 1.0 and got[2].protected
    assert got[3].expires_at == NOW + 14 * DAY and got[4].expires_at == 42
    assert all(r.embedding_status == "pending" for r in got) and after.memories.count() == 6
    assert after.events.filter("kind = 'memory_stored'").count() == 5


def test_resolve_entities_priority(spark, entities):
    known = entities(
        {"name": "Alpha", "normalized_name": "alpha", "canonical_key": "k:a"},
        {"name": "Beta Two", "normalized_name": "beta two"},
        {"name": "GAMMA", "normalized_name": None},
    )
    rows = incoming(
        spark, {"entity_name": "whatever", "entity_key": "k:a"}, {"entity_name": "beta-two", "entity_key": "k:b"},
        {"entity_name": "gamma"}, {"entity_name": "NewThing"}, {"entity_name": "new_thing"},
        {"entity_name": "Other", "entity_key": "k:b"}, {"entity_name": "Alpha", "entity_kind": "person"},
    )
    resolved, after = ingest.resolve_entities(rows, known, NOW)
    got = {r.seq: r.entity_id for r in resolved.collect()}
    assert got[0] == 1 and got[1] == 2 and got[2] == 3 and got[3] == got[4] and got[3] > 3
    assert got[5] == 2 and got[6] not in (1, got[3])
    table = {r.id: r for r in after.collect()}
    assert len(table) == 5 and table[2].canonical_key == "k:b" and table[3].normalized_name == "gamma"
    assert table[got[3]].name == "NewThing" and table[got[3]].normalized_name == "new thing"
    again, same = ingest.resolve_entities(rows, after, NOW)
    assert {r.seq: r.entity_id for r in again.collect()} == got and same.count() == 5


@pytest.mark.parametrize("names", [
    [("FooBar", None), ("foobar", "K"), ("qux", "K")],
    [("FooBar", None), ("foobar", "K"), ("qux", "K"), ("QUX", None), ("Qux", None), ("quX", "L"), ("last", "L"), ("LAST", None)],
])
def test_names_linked_over_several_steps_are_one_entity(spark, entities, store, names):
    rows = incoming(spark, *[{"entity_name": n, "entity_key": k} for n, k in names], {"entity_name": "alone"})
    resolved, after = ingest.resolve_entities(rows, entities({"name": "Old"}), NOW)
    got = {r.seq: r.entity_id for r in resolved.collect()}
    assert None not in got.values() and len({got[i] for i in range(len(names))}) == 1 and got[len(names)] != got[0]
    assert {r.id: r.name for r in after.collect()}[got[0]] == "FooBar"


def test_back_fill_stamps_the_entity(spark, entities):
    known = entities(
        {"name": "Beta Two", "normalized_name": "beta two", "updated_at": 1}, {"name": "GAMMA", "normalized_name": None, "updated_at": 1},
        {"name": "Same", "normalized_name": "same", "canonical_key": "k:s", "updated_at": 1})
    rows = incoming(spark, {"entity_name": "beta-two", "entity_key": "k:b"}, {"entity_name": "gamma"}, {"entity_name": "same", "entity_key": "k:s"})
    _, after = ingest.resolve_entities(rows, known, NOW)
    assert {r.name: r.updated_at for r in after.collect()} == {"Beta Two": NOW, "GAMMA": NOW, "Same": 1}


def test_update_memories(spark, store):
    s = store({"embedding": [1.0, 0.0]}, {"layer": "realize", "protected": True}, {"importance": 0.3}, {})
    ddl = "memory_id BIGINT, content STRING, layer STRING, importance DOUBLE"
    patches = spark.createDataFrame(
        [(1, "secret=x", None, None), (2, None, "context", None), (3, None, "decision", 0.95), (4, None, None, None),
         (9, "x", None, None), (5, None, None, None)], ddl)
    after, report = ingest.update_memories(s, patches, NOW)
    assert {r.memory_id: r.outcome for r in report.collect()} == {
        1: "updated", 2: "protected_layer", 3: "updated", 4: "nothing", 9: "not_found", 5: "not_found"}
    got = {r.id: r for r in after.memories.collect()}
    assert got[1].content == "secret=[REDACTED]" and got[1].embedding is None and got[1].embedding_status == "pending"
    assert got[3].layer == "learning" and got[3].protected and got[3].importance == 0.95
    assert got[4].importance == 0.5 and got[4].embedding_status == "done"
    assert after.events.count() == 2


def test_ingest_vectors(spark, memories):
    m = memories({"content": "abc", "embedding_status": "pending"}, {"archived_at": 1}, {"content_tokenized": "tok"})
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    nan = float("nan")
    vectors = spark.createDataFrame(
        [(1, 1, [1.0, 2.0], "new", sha("abc")), (2, 2, [1.0, 2.0], "new", ""), (3, 3, [1.0, 2.0], "new", sha("old")),
         (4, 1, [nan, 1.0], "new", ""), (5, 1, [1.0], "new", ""), (6, 8, [1.0, 2.0], "new", ""), (7, 1, [3.0, 4.0], "newer", None)],
        "seq BIGINT, id BIGINT, vec ARRAY<DOUBLE>, model STRING, content_sha1 STRING")
    after, outcomes = ingest.ingest_vectors(vectors, m, 2)
    assert {r.seq: r.outcome for r in outcomes.collect()} == {
        1: "ok", 2: "not_found", 3: "content_changed", 4: "bad_request", 5: "bad_request", 6: "not_found", 7: "ok"}
    row = after.filter("id = 1").first()
    assert row.embedding == [3.0, 4.0] and row.embedding_model == "newer" and row.embedding_status == "done"


def test_backlog_embed_reset_and_pages(store):
    s = store(
        {"embedding_status": "pending", "created_at": 3, "content": "one two"},
        {"embedding_status": "pending", "created_at": 1, "content": ""},
        {"embedding_status": "pending", "archived_at": 1}, {"embedding_status": "done"},
        {"embedding_status": "pending", "created_at": 2, "content": "x", "content_tokenized": "tokens"},
    )
    page = ingest.pending_backlog(s.memories).collect()
    assert [(r.id, r.text_for_embedding) for r in page] == [(1, "one two"), (5, "tokens")]
    assert [r.id for r in ingest.pending_backlog(s.memories, 1).collect()] == [5]
    assert ingest.pending_remaining(s.memories).first().remaining == 3
    after = ingest.embed_backlog(s, lambda: ingest.keyword_encoder(8), "kw", 8, limit=2)
    got = {r.id: r for r in after.memories.collect()}
    assert got[2].embedding_status == got[5].embedding_status == "done" and got[1].embedding_status == "pending"
    assert got[5].embedding_dim == 8 and np.linalg.norm(got[5].embedding) == pytest.approx(1)
    stuck = ingest.embed_backlog(s, lambda: lambda texts: None, "kw", 8)
    assert stuck.memories.filter("embedding_status = 'pending'").count() == 4
    reset = ingest.reset_stale_vectors(after.memories, "kw", 8)
    assert {r.id for r in reset.filter("embedding_status = 'done'").collect()} == {2, 5}
    report = {r["item"]: r.n for r in reports.embedding_status_report(s.memories, "m", 2).collect()}
    assert report == {"status:pending": 3, "status:done": 1, "stale": 0, "tokenized": 1, "untokenized": 3}
    assert ingest.tokenize_backlog_count(s.memories).first()[0] == 3
    filled = ingest.tokenize_backfill(s.memories)
    assert filled.filter("content_tokenized IS NULL").count() == 1
    assert ingest.tokenize_backfill(filled).exceptAll(filled).count() == 0


VEC = [1.0, 0.0]


def test_supersession_guards(memories):
    same, old = {"embedding": VEC}, NOW - 20 * DAY
    base = [
        {**same, "created_at": old},                                # 1 superseded by 2
        {**same, "created_at": old + 1},                            # 2 newest plain copy
        {**same, "layer": "learning", "created_at": old},           # 3 other layer
        {**same, "entity_id": 2, "created_at": old},                # 4 other entity
        {**same, "created_at": old - 95 * DAY},                     # 5 too old
        {"embedding": [0.0, 1.0], "created_at": old},               # 6 different
        {**same, "content": '{"a":1,"b":2}', "entity_id": 3},       # 7 same shape as 8
        {**same, "content": '{"b":3,"a":4}', "entity_id": 3, "created_at": NOW},
        {**same, "created_at": old, "archived_at": 1},              # 9 archived
    ]
    pairs = supersede.near_duplicate_pairs(memories(*base))
    assert [(r.new_id, r.old_id) for r in pairs.collect()] == [(2, 1)]


def test_supersession_peer_cap_and_candidates(memories):
    m = memories(*[{"embedding": VEC, "created_at": NOW - 1000 + i} for i in range(51)])
    pairs = supersede.near_duplicate_pairs(m, F.col("id") == 51, peer_limit=10)
    assert sorted(r.old_id for r in pairs.collect()) == list(range(41, 51))


@pytest.mark.parametrize("slice_rows", [4096, 11])
def test_pairs_equal_brute_force(memories, slice_rows):
    rng = np.random.default_rng(3)
    items = [{"entity_id": int(rng.integers(1, 3)) if i > 90 else 1, "created_at": NOW - int(rng.integers(0, 120)) * DAY,
              "embedding": [float(x) for x in rng.normal(size=2)]} for i in range(150)]
    got = {(r.new_id, r.old_id) for r in supersede.near_duplicate_pairs(memories(*items), peer_limit=7, threshold=0.9, slice_rows=slice_rows).collect()}
    want = set()
    for i, m in enumerate(items):
        older = [(p["created_at"], j + 1) for j, p in enumerate(items)
                 if p["entity_id"] == m["entity_id"] and (p["created_at"], j) < (m["created_at"], i)
                 and m["created_at"] - p["created_at"] <= 90 * DAY]
        for _, j in sorted(older, reverse=True)[:7]:
            a, b = np.float32(m["embedding"]).astype(float), np.float32(items[j - 1]["embedding"]).astype(float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                want.add((i + 1, j))
    assert got == want


def test_supersede_sweep_takes_earliest_match_and_is_idempotent(store):
    s = store(*[{"embedding": VEC, "created_at": NOW - 100 + i} for i in range(3)])
    once = supersede.supersede_sweep(s, NOW)
    got = {r.id: (r.superseded_by_id, r.archived_at) for r in once.memories.collect()}
    assert got == {1: (2, NOW), 2: (3, NOW), 3: (None, None)}
    twice = supersede.supersede_sweep(once, NOW + 1)
    for after, batches in ((once, 1), (twice, 2)):
        assert after.events.filter("kind = 'memory_superseded'").count() == 2
        told = after.events.filter("kind = 'supersess_batch_completed'").orderBy("id").collect()
        assert [json.loads(r.payload)["superseded"] for r in told] == [2, 0][:batches]


@pytest.mark.parametrize("limit", [200, None])
def test_confidence_is_rounded_once(memories, limit):
    """0.9768498 is 0.9768 in four places, but 0.9769 by way of six."""
    cos = 0.9768498
    rows = memories({"embedding": [1.0, 0.0], "created_at": NOW - 2}, {"embedding": [cos, (1 - cos * cos) ** 0.5], "created_at": NOW - 1})
    chosen, _ = supersede.swept(rows, peer_limit=limit)
    pairs = supersede.near_duplicate_pairs(rows)
    for found in (chosen, pairs):
        assert [r.c for r in found.select(F.round("cos", 4).alias("c")).collect()] == [0.9768]


def test_counts_of_tokens_are_exact_without_scaling():
    text = "one two two three three three"
    counts, scaled = (keyword_encoder(64, unit)([text])[0] for unit in (False, True))
    assert sum(counts) == 6 and all(x == int(x) for x in counts) and abs(sum(x * x for x in scaled) - 1) < 1e-12


def walked(items, limit, threshold=0.97, new=lambda i: True):
    """Row by row: {old: new}, comparisons and pairs skipped by shape, of a sweep in which superseded rows are peers no more."""
    order = sorted(range(len(items)), key=lambda i: (items[i]["created_at"], i))
    units = [np.float32(x["embedding"]).astype(float) for x in items]
    units = [u / np.linalg.norm(u) for u in units]
    group = [(x.get("entity_id", 1), x.get("layer", "context")) for x in items]
    taken, compared, skipped = {}, 0, 0
    for at, i in enumerate(order):
        if not new(i):
            continue
        peers = [j for j in order[:at] if group[j] == group[i] and j not in taken and items[i]["created_at"] - items[j]["created_at"] <= 90 * DAY]
        for j in peers[-limit:] if limit else peers:
            a, b = items[i].get("content", ""), items[j].get("content", "")
            if a.startswith("{") and a == b:
                skipped += 1
                continue
            compared += 1
            if units[i] @ units[j] >= threshold:
                taken[j] = i
    return {j + 1: i + 1 for j, i in taken.items()}, compared, skipped


def check_sweep(memories, items, limit, slice_rows=4096, threshold=0.97, new=lambda i: True):
    marked = None if new(0) and new(1) else F.col("id").isin([i + 1 for i in range(len(items)) if new(i)])
    chosen, counts = supersede.swept(memories(*items), marked, threshold, peer_limit=limit, slice_rows=slice_rows)
    want, compared, skipped = walked(items, limit, threshold, new)
    assert {r.old_id: r.new_id for r in chosen.collect()} == want
    assert counts.first().asDict() == {
        "embedded": sum(map(new, range(len(items)))), "compared": compared, "skipped_by_shape": skipped}
    return want


def test_superseded_rows_leave_the_peer_limit(memories):
    """One row, 250 equal ones, the first again: all but one of the 250 are gone by then, so the first is within 200 peers."""
    vectors = [[1.0, 0.0], *[[0.0, 1.0]] * 250, [1.0, 0.0]]
    items = [{"embedding": v, "created_at": NOW - 1000 + i} for i, v in enumerate(vectors)]
    want = check_sweep(memories, items, 200, slice_rows=64)
    assert want[1] == 252


@pytest.mark.parametrize("limit, slice_rows", [(3, 8), (7, 16), (None, 16), (200, 40)])
def test_sweep_equals_row_by_row(memories, limit, slice_rows):
    rng = np.random.default_rng(8)
    shapes = ["plain", "plain", '{"a":1}']
    items = [{"entity_id": int(rng.integers(1, 3)) if i > 110 else 1, "created_at": NOW - int(rng.integers(0, 120)) * DAY,
              "content": shapes[int(rng.integers(0, 3))], "embedding": [float(x) for x in rng.normal(size=2)]} for i in range(160)]
    check_sweep(memories, items, limit, slice_rows, threshold=0.9)
    check_sweep(memories, items, limit, slice_rows, threshold=0.9, new=lambda i: i % 3 == 2)


def test_sweep_hands_on_more_where_many_rows_go(memories):
    """A row that takes all of its peers at once brings older ones back within the limit."""
    vectors = [[0.0, 1.0]] + [[1.0, 0.0]] * 40 + [[0.0, 1.0]]
    items = [{"embedding": v, "created_at": NOW - 1000 + i} for i, v in enumerate(vectors)]
    check_sweep(memories, items, 2, slice_rows=5, new=lambda i: i > 38)


def test_maintenance_compares_newly_embedded_rows(store):
    vec = [1.0] + [0.0] * 63
    old = [{"content": f"old {i}", "embedding": vec, "embedding_dim": 64, "created_at": NOW - 50 + i} for i in range(2)]
    new = [{"content": "the same words", "content_tokenized": "the same words", "embedding_status": "pending", "created_at": NOW - 20 + i}
           for i in range(3)]
    after = maintenance_pass(store(*old, *new), NOW, phases=("supersede",))
    got = {r.id: (r.superseded_by_id, r.embedding_status) for r in after.memories.collect()}
    assert got == {1: (None, "done"), 2: (None, "done"), 3: (4, "done"), 4: (5, "done"), 5: (None, "done")}
    assert after.memories.columns == store().memories.columns


def test_supersede_manual(spark, store):
    s = store({}, {"protected": True}, {"layer": "goal"}, {"importance": 0.9}, {"archived_at": 1})
    pairs = spark.createDataFrame([(i, 7, i) for i in (1, 2, 3, 4, 5, 7)], "seq BIGINT, new_id BIGINT, old_id BIGINT")
    after, outcomes = supersede.supersede_manual(s, pairs, NOW)
    assert {r.old_id: r.outcome for r in outcomes.collect()} == {
        1: "superseded", 2: "skipped_protected", 3: "skipped_protected", 4: "skipped_protected", 5: "not_active", 7: "self"}
    row = after.memories.filter("id = 1").first()
    assert (row.superseded_by_id, row.supersession_confidence, row.archived_at) == (7, None, NOW)


def test_snapshot_budget_and_tiers(store, rows, memories):
    edits = [{"id": i, "session_id": "s", "file_path": f"/f{i % 12}", "operation": "edit", "occurred_at": i} for i in range(30)]
    src = '{"session_id":"s","kind":"x"}'
    notes = [{"layer": layer, "content": f"{layer} {i} " + "w" * 200, "importance": i / 10, "source": src}
             for layer in ("realize", "goal", "learning") for i in range(6)]
    notes += [{"layer": "goal", "source": '{"session_id":"t"}', "content": "only  goal"}]
    s = store(*notes, file_edits=rows("file_edits", edits))
    got = {r.session_id: r.snapshot_text for r in snapshots.snapshot_tiers(s).collect()}
    assert got["t"] == f"{snapshots.HEADING}\n### Goals\n- only goal"
    text = got["s"]
    assert len(text.encode()) <= 2048 and "Recent decisions" not in text and text.count("edits)") == 10
    assert "realize 5" in text and "realize 0" not in text and text.index("Active files") < text.index("Unresolved errors")
    wide = snapshots.snapshot_tiers(s, budget=10_000).filter("session_id = 's'").first().snapshot_text
    assert wide.count("- learning") == 5 and "…" in wide
    tight = snapshots.snapshot_tiers(s, budget=60).filter("session_id = 's'").first().snapshot_text
    assert tight.count("edits)") == 1 and tight.count("- realize") == 1 and "Goals" not in tight
    middle = snapshots.snapshot_tiers(s, budget=1500).filter("session_id = 's'").first().snapshot_text
    assert 1300 < len(middle.encode()) <= 1500 and middle.count("- realize") == 5 and middle.count("- goal") == 2


def test_session_snapshot_upsert_and_load(spark):
    ddl = "session_id STRING, snapshot_text STRING, created_at BIGINT"
    prev = spark.createDataFrame([("a", "old", NOW - DAY), ("b", "gone", NOW - 20 * DAY)], ddl)
    new = spark.createDataFrame([("a", "new", NOW)], ddl)
    after = snapshots.upsert_session_snapshots(prev, new, NOW)
    assert [tuple(r) for r in after.collect()] == [("a", "new", NOW)]
    ask = spark.createDataFrame([("a",), ("b",)], "session_id STRING")
    assert snapshots.load_session_snapshots(after, ask, NOW + 15 * DAY).count() == 0
    assert snapshots.load_session_snapshots(after, ask, NOW).count() == 1


def test_store_round_trip_and_replace(spark, store, tmp_path):
    s = store({"source": '{"session_id":"a"}'}, {"source": '{"session_id":"b"}'}, {})
    save_store(s, str(tmp_path / "v0"))
    with pytest.raises(Exception):
        save_store(s, str(tmp_path / "v0"))
    loaded = load_store(spark, str(tmp_path / "v0"))
    assert loaded.memories.exceptAll(s.memories).count() == 0 and loaded.memories.schema == s.memories.schema
    fresh = loaded.memories.filter("id = 2").withColumn("id", F.lit(9).cast("bigint"))
    ids = spark.createDataFrame([("b",)], "session_id STRING")
    out = replace_sessions(loaded, ids, fresh, loaded.file_edits, loaded.events.limit(0))
    assert sorted(r.id for r in out.memories.collect()) == [1, 3, 9]


def test_maintenance_twice_changes_nothing_more(store):
    cold = {"layer": "emotion", "importance": 0.1, "created_at": NOW - 300 * DAY, "last_accessed_at": NOW - 300 * DAY}
    s = store(cold, cold, {**cold, "layer": "implementation"}, {"expires_at": 1}, {"embedding_status": "pending", "content": "p"})
    check = {r.phase: r.n for r in maintenance_check(s, NOW).collect()}
    assert check == {"activation": 5, "scanned": 5, "pending": 1, "unembedded": 5, "expired": 1}
    once = maintenance_pass(s, NOW)
    got = {r.id: r for r in once.memories.collect()}
    assert {i for i, r in got.items() if r.archived_at} == {1, 2, 3, 4} and got[5].embedding_status == "done"
    assert len(got) == 6 and got[6].layer == "learning"
    twice = maintenance_pass(once, NOW)
    assert twice.memories.select("id", "archived_at", "layer").exceptAll(once.memories.select("id", "archived_at", "layer")).count() == 0


def test_scopes(spark):
    paths = spark.createDataFrame([("/a/b/x",), ("/a/c",), ("/ab/y",), ("/z",)], "file_path STRING")
    roots = spark.createDataFrame([("/a/",), ("/a/b",), ("/z",), ("/a/",)], "root STRING")
    assert sorted(r[0] for r in filters.path_roots_scope(paths, roots).collect()) == ["/a/b/x", "/a/c", "/z"]
    assert filters.path_roots_scope(paths, roots.limit(0)).count() == 4
    assert tuple(filters.path_scope_counts(paths, roots).first()) == (4, 3)
    hits = spark.createDataFrame([("Alpha", "project"), ("beta", "project"), ("Bob", "person")], "entity_name STRING, entity_kind STRING")
    assert sorted(r[0] for r in filters.project_scope(hits, "ALPHA").collect()) == ["Alpha", "Bob"]
    assert filters.project_scope(hits, None).count() == 3

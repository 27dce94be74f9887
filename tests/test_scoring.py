"""Scores, decay and life cycle on hand-made rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from mnemoria.functions import scoring
from mnemoria.operators import filters, lifecycle, recall, reports
from tests.conftest import DAY, NOW


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def archived(store):
    return ids(store.memories.filter("archived_at IS NOT NULL"))


def test_activation_prefers_recent_accesses(store, rows):
    log = [{"id": 1, "memory_id": 1, "accessed_at": NOW - 60 * DAY}]
    log += [{"id": 2 + i, "memory_id": 2, "accessed_at": NOW - i * 3600} for i in range(5)]
    s = store({}, {}, {"importance": 0.95}, {"layer": "goal"}, {"superseded_by_id": 2}, access_log=rows("access_log", log))
    after = {r.id: r for r in lifecycle.activation_refresh(s, NOW).memories.collect()}
    assert after[1].activation_score <= 0.3 * after[2].activation_score
    assert after[3].activation_score == after[4].activation_score == 1.0
    assert after[5].supersession_penalty == 0.0 and after[1].supersession_penalty == 1.0
    assert all(r.activation_computed_at == NOW for r in after.values())


def test_activation_skips_fresh_rows_and_prunes(store, rows):
    log = [{"id": i, "memory_id": 1, "accessed_at": NOW - i} for i in range(1, 61)]
    s = store({"activation_computed_at": NOW - 100, "activation_score": 0.25}, access_log=rows("access_log", log))
    after = lifecycle.activation_refresh(s, NOW)
    assert after.memories.first().activation_score == 0.25
    assert after.access_log.count() == 50 and after.access_log.agg(F.max("id")).first()[0] == 50
    assert lifecycle.activation_refresh(s, NOW, force=True).memories.first().activation_score > 0.5
    event = after.events.filter("kind = 'activation_batch_completed'").first()
    assert '"pruned_access_log":10' in event.payload


def test_base_level_formula(spark, memories, rows):
    log = rows("access_log", [{"id": i, "memory_id": 1, "accessed_at": NOW - 100 * i} for i in range(1, 4)])
    row = lifecycle.base_level_activation(memories({}), log, NOW).first()
    b = math.log(sum((100 * i) ** -0.5 for i in range(1, 4)))
    assert row.base_level == pytest.approx(b) and row.activation == pytest.approx(1 / (1 + math.exp(-(b + 6) / 1.5)))


def test_ttl_penalty_and_defaults(spark):
    df = spark.createDataFrame([(None,), (NOW + 5,), (NOW - 14 * DAY,), (NOW - 900 * DAY,)], "e BIGINT")
    got = [r[0] for r in df.select(scoring.ttl_penalty(F.col("e"), NOW)).collect()]
    assert got == [1.0, 1.0, pytest.approx(math.exp(-1)), 0.05]
    layers = spark.createDataFrame([("emotion",), ("goal",), ("learning",)], "l STRING")
    days = [r[0] for r in layers.select(scoring.default_expiry(F.col("l"), F.lit(0))).collect()]
    assert days == [14 * DAY, None, 365 * DAY]


def test_composite_factors_multiply(spark):
    cols = [F.lit(x) for x in (1.0, 50.0, 5.0, 0.5)]
    plain = scoring.composite(*cols, F.lit(None), F.lit(None), F.lit(None))
    halved = scoring.composite(*cols, F.lit(0.5), F.lit(0.5), F.lit(0.5))
    ignoring = scoring.composite(*cols, F.lit(0.5), F.lit(0.5), F.lit(0.5), ignore_decay=True)
    row = spark.range(1).select(plain.alias("p"), halved.alias("h"), ignoring.alias("i")).first()
    assert row.h / row.p == pytest.approx(0.125) and row.i == row.p
    assert row.p == pytest.approx(0.45 + 0.25 * 0.5 + 0.15 * 0.5 + 0.15 * 0.5)


def test_linear_relevance_cases(spark):
    df = spark.createDataFrame([(0.2, 0.8), (0.2, None), (None, 0.8), (None, None)], "f DOUBLE, v DOUBLE")
    got = [r[0] for r in df.select(scoring.linear_relevance(F.col("f"), F.col("v"), 0.25)).collect()]
    assert got == [pytest.approx(0.35), 0.2, 0.8, 0.5]


def test_rrf_values(spark):
    found = spark.createDataFrame(
        [("q", 1, 1, None), ("q", 2, 2, 3), ("q", 3, None, None)], "query_id STRING, id BIGINT, fts_rank INT, vec_rank INT"
    )
    got = {r.id: r for r in recall.rrf_fuse(found).collect()}
    assert got[1].rrf_raw == pytest.approx(1 / 61) and got[2].rrf_raw == pytest.approx(1 / 62 + 1 / 63)
    assert (got[1].relevance, got[2].relevance, got[3].relevance) == (0.0, 1.0, 0.5)


@pytest.mark.parametrize(
    "sizes,limit,offset,max_tokens,kept,used,stopped",
    [
        ([30] * 10, 200, 0, 100, 3, 90, "tokens"),
        ([500], 200, 0, 100, 1, 500, "end"),
        ([500, 1], 200, 0, 100, 1, 500, "tokens"),
        ([1] * 10, 4, 0, 100, 4, 4, "limit"),
        ([1] * 10, 4, 8, 100, 2, 2, "end"),
        ([50] * 200, 200, 0, 10**9, 120, 6000, "tokens"),
    ],
)
def test_token_budget(spark, sizes, limit, offset, max_tokens, kept, used, stopped):
    rows_ = [("q", i + 1, t) for i, t in enumerate(sizes)]
    ranked = spark.createDataFrame(rows_, "query_id STRING, rank INT, tokens BIGINT")
    got = recall.token_budget_select(ranked, "tokens", limit, offset, max_tokens).collect()
    assert (len(got), got[0].used_tokens, got[0].stopped_by) == (kept, used, stopped)
    assert sorted(r["rank"] for r in got) == list(range(offset + 1, offset + kept + 1))


def test_visibility_flags(memories):
    m = memories({}, {"archived_at": 1}, {"archived_at": 1, "superseded_by_id": 1}, {"superseded_by_id": 1})
    assert ids(filters.visible_memories(m)) == [1]
    assert ids(filters.visible_memories(m, include_archived=True)) == [1, 2]
    assert ids(filters.visible_memories(m, include_superseded=True)) == [1, 3, 4]
    assert ids(filters.visible_memories(m, True, True)) == [1, 2, 3, 4]


def test_expiry_and_idempotence(store):
    old = {"expires_at": NOW - 1}
    s = store(old, {**old, "importance": 0.9}, {**old, "layer": "goal"}, {**old, "protected": True},
              {**old, "embedding_status": "pending"}, {"expires_at": NOW + 100}, {})
    once = lifecycle.expire_ttl(s, NOW)
    assert archived(once) == [1] and once.events.filter("kind = 'memory_expired'").count() == 1
    twice = lifecycle.expire_ttl(once, NOW + 5)
    assert twice.memories.filter("id = 1").first().archived_at == NOW and twice.events.count() == 1


def test_forgetting_sweep_cap_leaves_the_rest(store):
    stale = {"last_accessed_at": NOW - 200 * DAY, "importance": 0.1}
    s = store(*[stale] * 7, {**stale, "protected": True}, {**stale, "layer": "goal"})
    summary = lifecycle.forget_sweep_summary(s.memories, NOW, 5).first()
    assert (summary.scanned, summary.to_drop, summary.affected, summary.remaining) == (8, 7, 5, 2)
    once = lifecycle.forgetting_sweep(s, NOW, 5)
    assert archived(once) == [1, 2, 3, 4, 5]
    assert archived(lifecycle.forgetting_sweep(once, NOW, 5)) == [1, 2, 3, 4, 5, 6, 7]


def test_forget_by_id_outcomes(spark, store):
    s = store({}, {"protected": True}, {"importance": 0.95}, {"archived_at": 5})
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id BIGINT")
    after, report = lifecycle.forget_by_id(s, asked, NOW)
    assert {r.id: r.outcome for r in report.collect()} == {
        1: "archived", 2: "preserved", 3: "preserved", 4: "already_archived", 9: "not_found"
    }
    assert archived(after) == [1, 4]
    same, report = lifecycle.forget_by_id(s, asked, NOW, dry_run=True)
    assert archived(same) == [4] and report.filter("id = 1").first().outcome == "would_archive"


def test_consolidation_of_a_cold_cluster(store):
    cold = {"layer": "implementation", "importance": 0.4, "created_at": NOW - 30 * DAY, "last_accessed_at": NOW - 30 * DAY}
    long = {**cold, "content": "x" * 300, "importance": 0.45}
    s = store(cold, cold, long, {**cold, "layer": "emotion"}, {**cold, "created_at": NOW - DAY})
    clusters = lifecycle.consolidation_clusters(s.memories, s.entities, NOW).collect()
    assert len(clusters) == 1 and clusters[0]["count"] == 3
    assert [len(e.fragment) for e in clusters[0].exemplars] == [201, 10, 10]
    assert clusters[0].importance == 0.55 and clusters[0].period_from == clusters[0].period_to == "2024-01-02"
    after = lifecycle.consolidate_cold(s, NOW)
    assert archived(after) == [1, 2, 3]
    learned = after.memories.filter("layer = 'learning'").first()
    assert learned.protected and learned.embedding_status == "pending" and learned.id == 6 and learned.expires_at is None
    assert ids(after.consolidations, "memory_id") == [1, 2, 3]
    kinds = {r.kind: r["count"] for r in after.events.groupBy("kind").count().collect()}
    assert kinds == {"memory_archived": 3, "memory_consolidated": 1}
    again = lifecycle.consolidate_cold(after, NOW)
    assert again.memories.count() == after.memories.count() and again.events.count() == after.events.count()


def test_momentum_bands(spark, entities, memories, rows):
    e = entities({}, {"name": "b"}, {"name": "c"})
    ev = rows("events", [{"id": i, "entity_id": 1, "kind": "x", "occurred_at": NOW - 60} for i in range(5)]
              + [{"id": 9, "entity_id": 2, "kind": "x", "occurred_at": NOW - 3 * DAY}])
    got = {r.id: r for r in reports.entity_momentum(e, ev, memories({"importance": 1.0, "created_at": NOW - DAY}), NOW).collect()}
    assert got[1].momentum == 10.0 and got[1].momentum_band == "surging"
    assert got[2].velocity == 2.0 and got[2].relative_volume == 10.0 and got[2].quality == 5.0
    assert got[3].momentum == 2.0 and got[3].momentum_band == "quiet"


def test_entity_overview_keeps_empty_entities(entities, memories):
    e = entities({"momentum_score": 1.0}, {"name": "empty", "momentum_score": 9.0})
    m = memories({}, {"layer": "realize", "importance": 0.9})
    got = reports.entity_overview(e, m).collect()
    assert [(r.id, r.memory_count) for r in got] == [(1, 2), (2, 0)] and got[0].pinned_count == 1
    assert [r.id for r in reports.entity_overview(e, m, min_memories=2).collect()] == [1]
    assert [r.id for r in reports.entity_overview(e, m, offset=1).collect()] == [2]
    assert reports.entity_overview(e, m, kind="person").count() == 0

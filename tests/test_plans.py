"""Plans and SQL equivalents of the registered queries."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from mnemoria.plans import fixtures as fx
from mnemoria.plans.oracle import ORACLES
from mnemoria.plans.queries import QUERIES
from mnemoria.sources import transcripts
from mnemoria.operators import filters, ingest, joins, lifecycle, search, sessions
from mnemoria.plans import queries
from mnemoria.sources import versions
from mnemoria.sources.notes import parse_notes

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUICK = ["visible_memories", "entity_overview", "store_stats", "file_edit_summary", "top_files", "prune_access_log",
         "redact_corpus", "triage_prompts", "chunk_documents", "chunk_diff", "forget_sweep_summary", "bm25_search",
         "near_duplicate_pairs", "attribute_intent", "debounce_edits"]
CHECKED = QUICK if os.environ.get("TEST_QUICK") else list(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if value != value else (int(value) if value.is_integer() else value)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    want = sorted_rows([c[0] for c in cursor.description], cursor.fetchall())
    assert sorted_rows(df.columns, df.collect()) == want


def test_stream_maintenance_runs_all_phases_on_a_store_with_memories(spark, monkeypatch):
    first, after, commit, load = [], [], versions.commit_base, versions.load_version
    monkeypatch.setattr(versions, "commit_base", lambda s, root, store, *a: (first.append(store.memories), commit(s, root, store, *a))[1])
    monkeypatch.setattr(versions, "load_version", lambda s, root, *a: (after.append(load(s, root, *a)), after[-1])[1])
    QUERIES["stream_maintenance"](spark, SF_DIR)
    whole = fx.v_memories(spark, SF_DIR)
    assert 0 < first[0].count() < whole.count()
    waiting = "embedding_status = 'pending' AND archived_at IS NULL"
    got = after[-1]
    arrived = got.memories.join(first[0].select("id"), "id", "left_anti")
    assert whole.where(waiting).count() and not got.memories.where(waiting).count()
    assert arrived.where("id % 10 = 0 AND embedding_dim = 64 AND embedding IS NOT NULL").count()
    assert got.events.where("kind = 'supersess_batch_completed'").count() == 1


def test_every_key_is_known():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def plan(df):
    for name in ("spark.sql.debug.maxToStringFields", "spark.sql.maxMetadataStringLength"):
        df.sparkSession.conf.set(name, "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entity_overview", "store_stats", "file_linked_memories", "memory_entity_view",
                                  "entity_momentum", "consolidation_clusters", "hybrid_candidates", "recall_staleness"])
def test_no_pairwise_joins(spark, name):
    text = plan(entry_points.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "memories")
    fx.v_memories(spark, SF_DIR).write.parquet(path)
    stored = spark.read.parquet(path)
    text = plan(lifecycle.expired_ids(filters.visible_memories(stored), fx.AS_OF))
    assert "IsNull(archived_at)" in text and "EqualTo(embedding_status,done)" in text and "LessThan(expires_at" in text
    schema = text.split("ReadSchema:")[1]
    assert "content" not in schema and "embedding:" not in schema


def test_top_k_is_cut_before_the_shuffle(spark):
    assert plan(lifecycle.prune_access_log(fx.v_access_log(spark, SF_DIR))).count("WindowGroupLimit") == 2
    hits = search.vector_search(fx.v_queries(spark, SF_DIR), fx.v_memories(spark, SF_DIR, True), fx.MODEL, fx.DIM, 0.25)
    assert plan(hits).count("WindowGroupLimit") == 2


def test_transcripts_are_not_sorted(spark):
    parsed, turns = transcripts.parse_lines(fx.v_transcript_lines(spark, SF_DIR))
    for df in (parsed, turns, sessions.extract_file_ops(turns)):
        assert "rangepartitioning" not in plan(df).lower()


def test_transcript_lines_are_parsed_once(spark):
    """What follows the parse reads its columns; no file is opened and no line parsed again."""
    parsed, turns = transcripts.parse_lines(fx.v_transcript_lines(spark, SF_DIR))
    for df in (parsed, turns):
        assert "parse_json" not in plan(df) and "from_json" not in plan(df)


def test_transcripts_are_files_in_few_folders(spark, tmp_path):
    """A folder of its own for each session cost a task to list it, and several processes to make it."""
    lines = fx.v_transcript_lines(spark, SF_DIR)
    fx.write_transcripts(lines, f"file://{tmp_path}/sessions")
    files = [f for f in (tmp_path / "sessions").rglob("*") if f.is_file()]
    want = {r.file: r.lines for r in lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("lines")).collect()}
    assert len(files) == len(want) and len({f.parent for f in files}) <= 64
    for f in files:
        assert f.read_text().splitlines() == [x.line for x in want[f"{f.stem}.jsonl"]]


def test_notes_are_parsed_once(spark):
    """No filter below the parsed columns builds the text again."""
    filters_ = [line for line in plan(parse_notes(fx.v_notes(spark, SF_DIR))).splitlines() if "Filter" in line]
    assert not any("array_join" in line or "split(raw" in line for line in filters_)


def test_incoming_texts_are_checked_once(spark):
    """What is accepted and what is rejected is read, not told from the texts again."""
    _, accepted, rejected = ingest.ingest_memories(queries._incoming(spark, SF_DIR), fx.v_store(spark, SF_DIR), fx.AS_OF)
    for rows in (accepted.select("layer"), rejected.select("reason")):
        assert "RLIKE" not in plan(rows)


def test_views_start_no_job(spark):
    memories, entities = fx.v_memories(spark, SF_DIR), fx.v_entities(spark, SF_DIR)
    spark.sparkContext.setJobGroup("lazy", "views")
    try:
        joins.memory_entity_view(memories, entities)
        filters.fetch_by_ids(spark.range(5), memories, entities, "warnings")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")

"""Streams over several small batches against their batch forms."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from mnemoria.model import make_store
from mnemoria.operators import lifecycle, sessions
from mnemoria.plans.imports import import_sessions
from mnemoria.sources import versions
from mnemoria.streaming import jobs
from tests.conftest import DAY, NOW
from tests.test_sessions import SESSION

ONCE = {"availableNow": True}


@pytest.fixture(scope="module")
def edits(spark, tmp_path_factory):
    """Edits in time order, one file per 50 rows."""
    path = str(tmp_path_factory.mktemp("edits") / "in")
    rows = [("edit", f"/f{i % 3}", NOW + i * 4, i) for i in range(200)]
    for at in range(0, 200, 50):
        spark.createDataFrame(rows[at : at + 50], "operation STRING, file_path STRING, occurred_at BIGINT, id BIGINT").coalesce(1).write.mode("append").parquet(path)
    return path


def read(spark, path, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def finish(spark, df, tmp_path, mode):
    query = jobs.to_folder(df, str(tmp_path / "out"), str(tmp_path / "state"), mode, ONCE)
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_debounce_parity(spark, edits, tmp_path):
    stream = read(spark, edits, "operation STRING, file_path STRING, occurred_at BIGINT, id BIGINT")
    got = finish(spark, jobs.stream_debounce_edits(stream, ["operation", "file_path"]), tmp_path, "append")
    assert got.select("batch").distinct().count() > 1
    want = sessions.debounce_edits(spark.read.parquet(edits), ["operation", "file_path"], "occurred_at", "id")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_access_window_parity(spark, edits, tmp_path):
    before = spark.conf.get(jobs.STATE_PROVIDER)
    jobs.use_rocksdb(spark)
    try:
        stream = read(spark, edits, "occurred_at BIGINT, id BIGINT")
        log = stream.select((F.col("id") % 2).alias("memory_id"), F.col("occurred_at").alias("accessed_at"))
        got = finish(spark, jobs.stream_access_window(log, 7), tmp_path, "update")
    finally:
        spark.conf.set(jobs.STATE_PROVIDER, before)
    last = got.groupBy("memory_id").agg(F.max_by("times", "batch").alias("times")).collect()
    log = spark.read.parquet(edits).select("id", (F.col("id") % 2).alias("memory_id"), F.col("occurred_at").alias("accessed_at"))
    want = lifecycle.prune_access_log(log, 7).groupBy("memory_id").agg(F.sort_array(F.collect_list("accessed_at"), False).alias("t"))
    assert {r.memory_id: list(r.times) for r in last} == {r.memory_id: r.t for r in want.collect()}


def test_momentum_counts(spark, edits, tmp_path):
    stream = read(spark, edits, "occurred_at BIGINT, id BIGINT").select(
        (F.col("id") % 2).alias("entity_id"), (F.col("occurred_at") + F.col("id") * 3600).alias("occurred_at"))
    got = finish(spark, jobs.stream_momentum(stream), tmp_path, "update")
    last = got.groupBy("entity_id", "window_end").agg(F.max_by(F.struct("events_7d", "events_24h"), "batch").alias("n")).collect()
    times = [(i % 2, NOW + i * 4 + i * 3600) for i in range(200)]
    for r in last:
        inside = [t for k, t in times if k == r.entity_id and r.window_end - 7 * DAY <= t < r.window_end]
        assert r.n.events_7d == len(inside) and r.n.events_24h == sum(t >= r.window_end - DAY for t in inside)
    assert len(last) > 10


def test_stream_import_replaces_sessions(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    versions.commit_base(spark, root, make_store(spark))

    def run():
        query = jobs.stream_import_sessions(spark, str(folder), root, str(tmp_path / "state"), NOW, ONCE)
        query.awaitTermination()
        return versions.load_version(spark, root)

    (folder / "a.jsonl").write_text("\n".join(SESSION[:6]) + "\n")
    first = run().memories.count()
    # The session went on; its longer transcript arrives as a new file.
    (folder / "b.jsonl").write_text("\n".join(SESSION) + "\n")
    after = run()
    assert first == 3 and after.memories.count() == 7 and after.file_edits.count() == 3 and after.events.count() == 1


def test_changed_transcripts_are_imported_again(spark, tmp_path):
    """Windows of change times leave out nothing and take nothing twice; the time read up to is committed with the rows."""
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    versions.commit_base(spark, root, make_store(spark))
    at = 1_700_000_000

    def put(name, lines, when):
        (folder / name).write_text("\n".join(lines) + "\n")
        os.utime(folder / name, (when, when))

    def run(until):
        done = jobs.import_changed(spark, str(folder), root, "grow", NOW, until)
        return done, versions.load_version(spark, root).memories.count()

    put("a.jsonl", SESSION[:6], at)
    assert run(at) == (False, 0)
    assert run(at + 1) == (True, 3)
    assert run(at + 1) == (False, 3) and run(at + 5) == (False, 3)
    put("a.jsonl", SESSION, at + 1)
    assert run(at + 6) == (True, 7)
    assert versions.manifest(spark, root)["batches"] == {"grow": at + 6}
    after = versions.load_version(spark, root)
    assert after.file_edits.count() == 3 and after.events.count() == 1


def test_running_stream_sees_a_file_grow(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    versions.commit_base(spark, root, make_store(spark))
    (folder / "a.jsonl").write_text("\n".join(SESSION[:6]) + "\n")
    query = jobs.stream_growing_sessions(
        spark, str(folder), root, str(tmp_path / "state"), lambda: NOW, {"processingTime": "1 second"}, rest=1
    )

    def wait_for(version):
        end = time.time() + 120
        while versions.manifest(spark, root)["version"] < version and time.time() < end and query.isActive:
            time.sleep(0.5)
        return versions.load_version(spark, root).memories.count()

    try:
        first = wait_for(1)
        with open(folder / "a.jsonl", "a") as out:
            out.write("\n".join(SESSION[6:]) + "\n")
        assert (first, wait_for(2)) == (3, 7)
    finally:
        query.stop()


def test_stream_maintenance(spark, memories, entities, tmp_path):
    root, arriving = str(tmp_path / "store"), str(tmp_path / "in")
    versions.commit_base(spark, root, make_store(spark, entities=entities({})))
    rows = memories({"expires_at": 1}, {"layer": "goal"})
    rows.write.parquet(arriving)
    stream = spark.readStream.schema(rows.schema).parquet(arriving)
    query = jobs.stream_maintenance(stream, root, str(tmp_path / "state"), lambda: NOW, ONCE, phases=("activation", "decay"))
    query.awaitTermination()
    after = versions.load_version(spark, root).memories.orderBy("id").collect()
    assert [r.archived_at for r in after] == [NOW, None] and all(r.activation_computed_at == NOW for r in after)
    assert jobs.MAINTENANCE_TRIGGER == {"processingTime": "600 seconds"}


def test_two_streams_on_one_store(spark, memories, entities, tmp_path):
    """Each commit builds on the last one of either stream, a committed batch is not applied again, and a lost race fails."""
    root = str(tmp_path / "store")
    versions.commit_base(spark, root, make_store(spark, entities=entities({})))

    def add(number):
        return lambda store: store.with_(memories=store.memories.unionByName(memories({"id": number})))

    for stream, batch in (("a", 0), ("b", 0), ("b", 0), ("a", 1), ("b", 1)):
        versions.evolve(spark, root, stream, batch, add(batch + 10 * (stream == "b")))
    assert sorted(r.id for r in versions.load_version(spark, root).memories.collect()) == [0, 1, 10, 11]
    assert versions.manifest(spark, root)["version"] == 4
    kept = {p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")}
    assert sum(n.startswith("committed-") for n in kept) == 3
    assert sum(n.startswith("v") for n in kept) == 5  # the base and four changes, which the versions left still name
    with pytest.raises(Exception, match="(?i)exist"):
        versions.commit_base(spark, root, make_store(spark), 4)


def test_a_file_grown_in_place_is_imported_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "old.jsonl").write_text("\n".join(SESSION).replace('"S1"', '"S0"') + "\n")
    os.utime(folder / "old.jsonl", (1_000_000_000, 1_000_000_000))
    (folder / "a.jsonl").write_text("\n".join(SESSION[:6]) + "\n")
    first = import_sessions(spark, str(folder), make_store(spark), NOW, "2020-01-01T00:00:00")
    (folder / "a.jsonl").write_text("\n".join(SESSION) + "\n")
    after = import_sessions(spark, str(folder), first, NOW, "2020-01-01T00:00:00")
    assert first.memories.count() == 3 and after.memories.count() == 7 and after.events.count() == 1

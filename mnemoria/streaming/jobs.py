"""Structured Streaming forms of import, access windows, debounce, momentum and maintenance."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from mnemoria.functions.scoring import ACCESS_WINDOW
from mnemoria.model import Store
from mnemoria.operators.sessions import DEBOUNCE_SECONDS
from mnemoria.plans.imports import import_parsed
from mnemoria.plans.maintenance import maintenance_pass
from mnemoria.runtime import ship_package
from mnemoria.sources.transcripts import changed_lines, parse_lines
from mnemoria.sources.versions import evolve, manifest

MAINTENANCE_TRIGGER = {"processingTime": "600 seconds"}
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Row-level state needs the RocksDB provider; it also keeps large state off the heap."""
    spark.conf.set(STATE_PROVIDER, ROCKSDB)


def stream_import_sessions(
    spark: SparkSession, folder: str, store_root: str, checkpoint: str, as_of: int, trigger: dict, glob: str = "*.jsonl"
) -> StreamingQuery:
    """New transcript files replace their session in the store (a version must be committed)."""
    lines = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    located = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )

    def absorb(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.withColumn("row", F.monotonically_increasing_id())
        evolve(batch.sparkSession, store_root, checkpoint, batch_id, lambda s: import_parsed(*parse_lines(ordered), s, as_of))

    return located.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def import_changed(
    spark: SparkSession, folder: str, store_root: str, name: str, as_of: int, until: int, glob: str = "*.jsonl"
) -> bool:
    """Import the transcripts changed before ``until`` (epoch seconds) and not before the time up to which ``name`` has read.

    That time is committed with the rows, as one version of the store: a failed call is repeated from where the last one ended,
    and one that is repeated after its commit does nothing. Tells whether there was anything to import.
    """
    since = manifest(spark, store_root)["batches"].get(name, 0)
    if since >= until:
        return False
    lines = changed_lines(spark, folder, since, until, glob)
    if lines.isEmpty():
        return False
    evolve(spark, store_root, name, until, lambda s: import_parsed(*parse_lines(lines), s, as_of))
    return True


def stream_growing_sessions(
    spark: SparkSession, folder: str, store_root: str, checkpoint: str, as_of: Callable[[], int], trigger: dict, glob: str = "*.jsonl",
    rest: int = 2,
) -> StreamingQuery:
    """As ``stream_import_sessions``, for transcripts that grow in place: a file that changes is read again and replaces its session.

    A file stream shows a path once. Here a clock drives the batches, and each takes the files by the time of their last
    change: a file that changes again gets a later time and comes again. Only changes at least ``rest`` seconds old are
    taken, so that no change can still fall into a span that is done; clocks may differ by less than that.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        import_changed(batch.sparkSession, folder, store_root, checkpoint, as_of(), int(time.time()) - rest, glob)

    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return beats.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class NewestAccesses(StatefulProcessor):
    """Keeps the newest access times of a memory and reports them after each batch."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.times.get()]
        for pdf in rows:
            # Cut after every piece, so that a busy memory never holds more than one piece more.
            held = sorted([*held, *pdf["accessed_at"].tolist()], reverse=True)[: self.window]
        self.times.put([(t,) for t in held])
        yield pd.DataFrame({"memory_id": [key[0]], "accesses": [len(held)], "times": [held]})

    def close(self) -> None:
        pass


def stream_access_window(accesses: DataFrame, window: int = ACCESS_WINDOW) -> DataFrame:
    """(memory_id, accesses, times) of every memory touched by a batch; call use_rocksdb first."""
    ship_package(accesses.sparkSession)
    return accesses.select("memory_id", "accessed_at").groupBy("memory_id").transformWithStateInPandas(
        NewestAccesses(window),
        outputStructType="memory_id BIGINT, accesses BIGINT, times ARRAY<BIGINT>",
        outputMode="Update",
        timeMode="None",
    )


def stream_debounce_edits(edits: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Edits that open a new ten-second span of their key. Rows later than ``delay`` are dropped.

    ``edits`` has the string columns ``keys``, ``occurred_at`` seconds and ``id``. The state of a
    key is one time, and it expires with the watermark.
    """
    timed = edits.select(*keys, "occurred_at", "id").withColumn("at", F.timestamp_seconds("occurred_at"))
    schema = ", ".join(f"{k} STRING" for k in keys) + ", occurred_at BIGINT, id BIGINT"

    def walk(key: tuple, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first: dict[int, int] = {}
        for pdf in pieces:
            # One entry per second, whatever the number of rows.
            for at, row_id in pdf.groupby("occurred_at")["id"].min().items():
                first[at] = min(row_id, first.get(at, row_id))
        last = state.get[0] if state.exists else None
        kept = []
        for at in sorted(first):
            if last is None or at == 0 or abs(at - last) >= DEBOUNCE_SECONDS:
                kept.append((*key, at, first[at]))
                last = at or None
        if last is not None:
            state.update((last,))
            floor = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(last) * 1000 + DEBOUNCE_SECONDS * 1000, floor + 1))
        yield pd.DataFrame(kept, columns=[*keys, "occurred_at", "id"])

    ship_package(edits.sparkSession)
    return timed.withWatermark("at", delay).groupBy(*keys).applyInPandasWithState(
        walk, schema, "last BIGINT", "append", "EventTimeTimeout"
    )


def stream_momentum(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sliding counts per entity: events of the last seven days and of the last day, for each day.

    Both counts are partial aggregates, so a busy entity is one row per task and window.
    """
    at = F.timestamp_seconds("occurred_at")
    timed = events.select("entity_id", "occurred_at").withColumn("at", at).withWatermark("at", delay)
    last_day = F.col("at") >= F.col("w.end") - F.expr("INTERVAL 1 DAY")
    return timed.withColumn("w", F.window("at", "7 days", "1 day")).groupBy("entity_id", "w").agg(
        F.count("*").alias("events_7d"), F.sum(F.when(last_day, 1).otherwise(0)).alias("events_24h")
    ).select("entity_id", F.col("w.end").cast("bigint").alias("window_end"), "events_7d", "events_24h")


def stream_maintenance(
    writes: DataFrame, store_root: str, checkpoint: str, as_of: Callable[[], int], trigger: dict | None = None, **options
) -> StreamingQuery:
    """Add arriving memories and run the maintenance phases, at most once per trigger interval."""

    def tend(batch: DataFrame, batch_id: int) -> None:
        def step(store: Store) -> Store:
            grown = store.with_(memories=store.memories.unionByName(batch.select(store.memories.columns)))
            return maintenance_pass(grown, as_of(), **options)

        evolve(batch.sparkSession, store_root, checkpoint, batch_id, step)

    writer = writes.writeStream.foreachBatch(tend).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or MAINTENANCE_TRIGGER)).start()


def to_folder(df: DataFrame, folder: str, checkpoint: str, mode: str, trigger: dict) -> StreamingQuery:
    """Write every batch of ``df`` with its number to its own Parquet folder below ``folder``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer: DataStreamWriter = df.writeStream.outputMode(mode).foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()

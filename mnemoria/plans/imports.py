"""Import of transcripts and curated notes into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoria.functions import text
from mnemoria.functions.redact import redacted
from mnemoria.model import Store
from mnemoria.operators import sessions as mining
from mnemoria.operators.ingest import event_rows, next_id, resolve_entities
from mnemoria.operators.joins import link_edits_to_memories
from mnemoria.runtime import cut_lineage
from mnemoria.scale import global_positions
from mnemoria.sources.notes import scan_curated_notes
from mnemoria.sources.store import replace_sessions
from mnemoria.sources.transcripts import scan_transcripts


def import_sessions(
    spark: SparkSession, path: str, store: Store, as_of: int, modified_after: str | None = None, glob: str = "*.jsonl"
) -> Store:
    """Transcripts below ``path`` into memories, edits and one event per session; a re-import replaces.

    With ``modified_after``, only files changed since then are read: run at intervals, that takes in transcripts that
    grow in place, which a file stream would never show again.
    """
    return import_parsed(*scan_transcripts(spark, path, modified_after, glob), store, as_of)


def project_entities(projects: DataFrame, store: Store, as_of: int) -> tuple[DataFrame, DataFrame]:
    """``projects(seq, project, ...)`` with ``entity_id``, and the entities with new projects added."""
    named = projects.select(
        "*",
        F.lit("project").alias("entity_kind"),
        F.col("project").alias("entity_name"),
        F.concat(F.lit("project:"), F.lower("project")).alias("entity_key"),
    )
    return resolve_entities(named, store.entities, as_of, backfill_key=False)


def import_parsed(sessions: DataFrame, turns: DataFrame, store: Store, as_of: int) -> Store:
    turns = cut_lineage(turns)
    sessions = cut_lineage(sessions)
    file_ops = cut_lineage(mining.extract_file_ops(turns))
    votes = mining.session_project_vote(sessions, file_ops).withColumn("seq", F.xxhash64("session_id"))
    resolved, entities = project_entities(votes, store, as_of)
    owners = cut_lineage(resolved.select("session_id", "entity_id"))

    found = mining.extract_memories(sessions, turns, file_ops).join(owners, ["session_id"])
    placed = cut_lineage(
        global_positions(found, ["session_id", "rule_no", "at", "content"], "id", next_id(store.memories))
    )
    clean = redacted(F.col("content"))
    stamp = F.lit(as_of).cast("bigint")
    source = F.to_json(F.struct("session_id", "turn_uuid", "kind"))
    memories = placed.select(
        "id", "entity_id", "layer", clean.alias("content"), "importance", (F.col("layer") == "realize").alias("protected"),
        source.alias("source"), stamp.alias("created_at"), stamp.alias("last_accessed_at"), F.lit(0).alias("access_count"),
        F.lit("pending").alias("embedding_status"), text.tokenized(clean).alias("content_tokenized"),
    )
    per_file = placed.filter(F.col("rule_no") == 3).select("session_id", "file_path", F.col("id").alias("memory_id"))
    edits = mining.session_edits(file_ops).withColumn("memory_id", F.lit(None).cast("bigint"))
    linked = link_edits_to_memories(edits, per_file)
    numbered = global_positions(linked, ["session_id", "seq", "call"], "id", next_id(store.file_edits)).select(
        "id", "session_id", "memory_id", "file_path", "operation", "turn_uuid",
        redacted(F.col("context_snippet")).alias("context_snippet"), "occurred_at",
    )
    numbered = cut_lineage(numbered)

    per_session = placed.groupBy("session_id").agg(F.count("*").alias("memories"))
    edit_counts = numbered.groupBy("session_id").agg(F.count("*").alias("file_edits"))
    overview = mining.session_overview(sessions, turns, file_ops)
    told = (
        overview.join(owners, "session_id").join(per_session, "session_id", "left").join(edit_counts, "session_id", "left")
        .fillna(0, ["memories", "file_edits"])
    )
    stats = F.struct(
        (F.col("turns_user") + F.col("turns_assistant")).alias("turns_total"),
        F.col("turns_meaningful").alias("turns_meaningful_user"),
        "file_ops_raw",
        F.col("files_touched").alias("file_ops_unique_paths"),
    )
    payload = F.to_json(F.struct("session_id", "memories", "file_edits", stats.alias("stats")))
    when = F.when(F.col("started_at") > 0, F.col("started_at")).otherwise(stamp)
    events = told.select(
        F.col("entity_id"), F.lit("session_imported").alias("kind"), payload.alias("payload"), when.alias("occurred_at")
    )
    new_events = global_positions(events, ["payload"], "id", next_id(store.events))
    updated = store.with_(entities=cut_lineage(entities))
    # The target tables take the new rows after the old ones of these sessions are gone.
    filled = _full(updated, memories, numbered, new_events)
    return replace_sessions(updated, sessions, *filled)


def _full(store: Store, memories: DataFrame, edits: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    out = []
    for rows, table in ((memories, store.memories), (edits, store.file_edits), (events, store.events)):
        kinds = dict(table.dtypes)
        out.append(
            rows.select(
                *[
                    (F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c)
                    for c in table.columns
                ]
            )
        )
    return tuple(out)


def import_notes(spark: SparkSession, path: str, store: Store, as_of: int, most: int | None = None) -> Store:
    """Curated notes below ``path``, whole or their first ``most`` characters; each folder is one replaceable pseudo session."""
    return import_parsed_notes(scan_curated_notes(spark, path, most), store, as_of)


def import_parsed_notes(notes: DataFrame, store: Store, as_of: int) -> Store:
    """The project of a folder of notes is the last part of its parent folder's name."""
    # Texts are parsed and redacted once; what follows reads the columns it needs.
    notes = cut_lineage(notes.drop("body"), "notes")
    folder = F.element_at(F.split(F.regexp_replace("dir", r"/memory$", ""), "/"), -1)
    project = F.element_at(F.filter(F.split(folder, "--"), lambda s: s != ""), -1)
    keyed = notes.withColumns(
        {
            "session_id": F.concat(F.lit("memory-md:"), folder),
            "project": F.coalesce(F.nullif(project, F.lit("")), folder),
            "seq": F.xxhash64("path"),
        }
    )
    resolved, entities = project_entities(keyed, store, as_of)
    resolved = cut_lineage(resolved)
    placed = global_positions(resolved, ["path"], "id", next_id(store.memories))
    stamp = F.lit(as_of).cast("bigint")
    source = F.to_json(
        F.struct("session_id", F.lit("memory_file").alias("kind"), "file", "type", "origin_session_id")
    )
    memories = placed.select(
        "id", "entity_id", "layer", "content", "importance", F.lit(False).alias("protected"), source.alias("source"),
        stamp.alias("created_at"), stamp.alias("last_accessed_at"), F.lit(0).alias("access_count"),
        F.lit("pending").alias("embedding_status"), text.tokenized(F.col("content")).alias("content_tokenized"),
    )
    folders = resolved.groupBy("session_id").agg(F.count("*").alias("files"), F.min("entity_id").alias("entity_id"))
    payload = F.to_json(F.struct("session_id", "files"))
    events = event_rows(folders, F.col("entity_id"), F.lit("memory_files_imported"), payload, as_of)
    new_events = global_positions(events, ["payload"], "id", next_id(store.events))
    updated = store.with_(entities=cut_lineage(entities))
    no_edits = store.file_edits.limit(0)
    filled = _full(updated, memories, no_edits, new_events)
    return replace_sessions(updated, folders, *filled)

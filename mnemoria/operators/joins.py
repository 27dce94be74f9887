"""Joins shared by several jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemoria.scale import carry_forward


def memory_entity_view(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """Memories with entity name, kind and momentum. One entity may own most of the memories."""
    names = entities.select(
        F.col("id").alias("entity_id"),
        F.col("name").alias("entity_name"),
        F.col("kind").alias("entity_kind"),
        "momentum_score",
    )
    return memories.join(names, ["entity_id"])


def attribute_intent(turns: DataFrame) -> DataFrame:
    """Each turn with the latest real user request at or before it (at most 600 characters).

    Needs ``session_id, seq, role, text, has_tool_result``; ``seq`` is an integer order.
    """
    from mnemoria.functions import text as t

    speaks = (F.col("role") == "user") & ~F.col("has_tool_result") & ~t.is_noise(F.col("text"))
    marked = turns.withColumn("__said", F.when(speaks, t.strip(F.col("text"))))
    filled = carry_forward(marked, ["session_id"], "seq", "__said", "__intent")
    return filled.withColumn("intent", F.substring(F.coalesce("__intent", F.lit("")), 1, 600)).drop("__said", "__intent")


def link_edits_to_memories(edits: DataFrame, file_memories: DataFrame) -> DataFrame:
    """Edits with the id of their path's memory in the same session.

    ``file_memories(session_id, file_path, memory_id)`` holds one row per path and session.
    """
    one = file_memories.groupBy("session_id", "file_path").agg(F.max("memory_id").alias("memory_id"))
    return edits.drop("memory_id").join(one, ["session_id", "file_path"], "left")


def file_linked_memories(
    edits: DataFrame, memories: DataFrame, entities: DataFrame, path_substring: str, limit: int = 20
) -> DataFrame:
    from mnemoria.operators.reports import path_matches

    linked = edits.filter(path_matches(path_substring)).select(F.col("memory_id").alias("id")).distinct()
    top = (
        memories.select("id", "entity_id", "layer", "content", "importance")
        .join(linked, "id", "left_semi")
        .orderBy(F.desc("importance"), "id")
        .limit(limit)
    )
    preview = F.when(F.char_length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(
        F.col("content")
    )
    return (
        memory_entity_view(top, entities)
        .select("id", "entity_name", "layer", "importance", preview.alias("preview"))
        .orderBy(F.desc("importance"), "id")
    )

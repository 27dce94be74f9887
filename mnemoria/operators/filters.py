"""Predicates and scopes over memories, turns, prompts, paths and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.functions import scoring, text


def visible(include_archived: bool = False, include_superseded: bool = False) -> Column:
    """Three-way rule; every branch is a plain null test, so it reaches the Parquet scan."""
    if include_archived and include_superseded:
        return F.lit(True)
    if include_archived:
        return F.col("superseded_by_id").isNull()
    if include_superseded:
        return F.col("archived_at").isNull() | F.col("superseded_by_id").isNotNull()
    return F.col("superseded_by_id").isNull() & F.col("archived_at").isNull()


def visible_memories(memories: DataFrame, include_archived: bool = False, include_superseded: bool = False) -> DataFrame:
    return memories.filter(visible(include_archived, include_superseded))


def fetch_by_ids(
    ids: DataFrame, memories: DataFrame, entities: DataFrame, layer: str | None = None, **flags: bool
) -> DataFrame:
    """Rows named in ``ids(id)``, with the usual visibility and a neutral relevance.

    ``layer`` may be an alias; a word that names no layer filters nothing.
    """
    from mnemoria.operators.joins import memory_entity_view

    wanted = visible_memories(memories, **flags)
    if layer:
        named = text.resolve_layer(F.lit(layer))
        wanted = wanted.filter(named.isNull() | (F.col("layer") == named))
    found = wanted.join(ids.select("id").distinct(), "id", "left_semi")
    return memory_entity_view(found, entities).withColumn("relevance", F.lit(scoring.NEUTRAL_RELEVANCE))


def filter_noise_turns(turns: DataFrame) -> DataFrame:
    return turns.filter(~text.is_noise(F.col("text")))


def flag_pasted_text(docs: DataFrame, column: str = "text") -> DataFrame:
    flagged = docs.withColumn("rule", text.paste_rule(F.col(column)))
    return flagged.withColumn("is_pasted", F.col("rule").isNotNull())


def triage_prompts(prompts: DataFrame, column: str = "text") -> DataFrame:
    reason = text.triage_reason(F.col(column))
    query = text.first_code_points(text.collapse(F.col(column)), 2000)
    return (
        prompts.withColumn("reason", reason)
        .withColumn("should_recall", F.col("reason") == "meaningful")
        .withColumn("query", F.when(F.col("should_recall"), query).otherwise(""))
    )


def project_scope(hits: DataFrame, project: str | None) -> DataFrame:
    if not project:
        return hits
    return hits.filter((F.col("entity_kind") != "project") | (F.lower("entity_name") == project.lower()))


def path_roots_scope(paths: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows whose path starts with any of ``roots(root)``; no roots means no filter.

    Each distinct path offers all its prefixes, as many as it has characters, and those are matched by equality. The
    empty prefix is a root only where there is no other.
    """
    none = roots.agg(F.count("root").alias("n")).where("n = 0").select(F.lit("").alias("root"))
    wanted = roots.select("root").unionByName(none).distinct()
    size = F.char_length(path)
    offered = paths.select(path).distinct().select(
        path, F.explode(F.transform(F.sequence(F.lit(0), size), lambda n: F.substring(F.col(path), F.lit(1), n))).alias("root")
    )
    inside = offered.join(wanted, "root", "left_semi").select(path).distinct()
    return paths.join(inside, path, "left_semi").select(paths.columns)


def path_scope_counts(paths: DataFrame, roots: DataFrame, path: str = "file_path") -> DataFrame:
    before = paths.agg(F.count("*").alias("before"))
    after = path_roots_scope(paths, roots, path).agg(F.count("*").alias("after"))
    merged = before.unionByName(after, allowMissingColumns=True)
    return merged.agg(F.max("before").alias("before"), F.max("after").alias("after"))

"""Table schemas and the store: a named set of DataFrames that jobs take and return."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

LAYERS = ["goal", "context", "emotion", "implementation", "realize", "learning"]
ENTITY_KINDS = ["person", "company", "project", "concept", "file", "other"]

SCHEMAS = {
    "entities": (
        "id BIGINT, kind STRING, name STRING, normalized_name STRING, canonical_key STRING, "
        "momentum_score DOUBLE, momentum_at BIGINT, created_at BIGINT, updated_at BIGINT"
    ),
    "memories": (
        "id BIGINT, entity_id BIGINT, layer STRING, content STRING, importance DOUBLE, protected BOOLEAN, "
        "source STRING, created_at BIGINT, last_accessed_at BIGINT, access_count INT, archived_at BIGINT, "
        "superseded_by_id BIGINT, supersession_confidence DOUBLE, expires_at BIGINT, embedding ARRAY<FLOAT>, "
        "embedding_model STRING, embedding_status STRING, embedding_dim INT, content_tokenized STRING, "
        "activation_score DOUBLE, ttl_penalty DOUBLE, supersession_penalty DOUBLE, activation_computed_at BIGINT"
    ),
    "access_log": "id BIGINT, memory_id BIGINT, accessed_at BIGINT",
    "events": "id BIGINT, entity_id BIGINT, kind STRING, payload STRING, occurred_at BIGINT",
    "file_edits": (
        "id BIGINT, session_id STRING, memory_id BIGINT, file_path STRING, operation STRING, turn_uuid STRING, "
        "context_snippet STRING, occurred_at BIGINT"
    ),
    "file_snapshots": (
        "path STRING, content_hash STRING, mtime BIGINT, size_bytes BIGINT, "
        "chunks ARRAY<STRUCT<id:STRING,kind:STRING,start_line:INT,end_line:INT,hash:STRING>>, "
        "last_read_at BIGINT, read_count INT"
    ),
    # One row per replaced memory, so that a cluster of any size is never one array.
    "consolidations": (
        "learning_id BIGINT, memory_id BIGINT, entity_id BIGINT, original_layer STRING, created_at BIGINT"
    ),
    "session_snapshots": "session_id STRING, snapshot_text STRING, created_at BIGINT",
}


@dataclass(frozen=True)
class Store:
    entities: DataFrame
    memories: DataFrame
    access_log: DataFrame
    events: DataFrame
    file_edits: DataFrame
    file_snapshots: DataFrame
    consolidations: DataFrame
    session_snapshots: DataFrame

    def with_(self, **tables: DataFrame) -> "Store":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def make_store(spark: SparkSession, **tables: DataFrame) -> Store:
    """A store from the given tables; the others are empty."""
    return Store(**{name: tables.get(name, empty_table(spark, name)) for name in SCHEMAS})


def column_names(table: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in _split_top_level(SCHEMAS[table])]


def _split_top_level(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]

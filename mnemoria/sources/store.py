"""Reading, writing and replacing parts of a store kept as Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoria.model import SCHEMAS, Store


def load_store(spark: SparkSession, path: str) -> Store:
    return Store(**{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in SCHEMAS.items()})


def save_store(store: Store, path: str, overwrite: bool = False) -> None:
    """Write every table below a new folder; an existing one is refused unless ``overwrite``."""
    for name, table in store.tables().items():
        table.write.mode("overwrite" if overwrite else "error").parquet(f"{path}/{name}")


def session_of(json_column: str):
    """The session id inside a JSON text column (memory source or event payload)."""
    return F.get_json_object(F.col(json_column), "$.session_id")


def replace_sessions(store: Store, sessions: DataFrame, memories: DataFrame, edits: DataFrame, events: DataFrame) -> Store:
    """Remove all rows of the given session ids (one column ``session_id``) and add the new ones."""
    incoming = sessions.select("session_id").distinct()

    def without(table: DataFrame, session) -> DataFrame:
        kept = table.withColumn("session_id", session).join(incoming, ["session_id"], "left_anti")
        return kept if "session_id" in table.columns else kept.drop("session_id")

    return store.with_(
        memories=without(store.memories, session_of("source")).unionByName(memories),
        file_edits=without(store.file_edits, F.col("session_id")).unionByName(edits),
        events=without(store.events, session_of("payload")).unionByName(events),
    )

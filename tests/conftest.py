from __future__ import annotations

import pytest

from mnemoria.model import SCHEMAS, column_names, make_store
from mnemoria.runtime import build_session

NOW = 1_706_745_600
DAY = 86_400


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MEMORY = dict(
    entity_id=1, layer="context", content="plain note", importance=0.5, protected=False, created_at=NOW - 10 * DAY,
    last_accessed_at=NOW - 10 * DAY, access_count=0, embedding_status="done", embedding_model="m", embedding_dim=2,
)
ENTITY = dict(kind="project", name="Alpha", normalized_name="alpha", momentum_score=0.0, created_at=NOW - 100 * DAY)


@pytest.fixture(scope="session")
def rows(spark):
    """rows(table, [{...}, ...]): a DataFrame in the table's schema, missing columns null."""

    def make(table: str, items: list[dict]):
        names = column_names(table)
        return spark.createDataFrame([tuple(item.get(n) for n in names) for item in items], SCHEMAS[table])

    return make


@pytest.fixture(scope="session")
def memories(rows):
    return lambda *items: rows("memories", [{"id": i + 1, **MEMORY, **item} for i, item in enumerate(items)])


@pytest.fixture(scope="session")
def entities(rows):
    return lambda *items: rows("entities", [{"id": i + 1, **ENTITY, **item} for i, item in enumerate(items)])


@pytest.fixture(scope="session")
def store(spark, memories, entities):
    def make(*items: dict, **tables):
        return make_store(spark, **{"memories": memories(*items), "entities": entities({}), **tables})

    return make


@pytest.fixture(scope="session")
def queries(spark):
    ddl = "query_id STRING, text STRING, vec ARRAY<FLOAT>, layer STRING, entity_name STRING"

    def make(*items: dict):
        names = ["query_id", "text", "vec", "layer", "entity_name"]
        return spark.createDataFrame([tuple({"query_id": str(i), **q}.get(n) for n in names) for i, q in enumerate(items)], ddl)

    return make

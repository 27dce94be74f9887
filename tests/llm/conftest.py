from __future__ import annotations

import pytest

DDL = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """table(rows, name, ddl): writes rows as <folder>/<name>.parquet and gives the folder."""

    def make(rows, name="documents", ddl=DDL, folder=None):
        folder = folder or str(tmp_path_factory.mktemp("tables"))
        width = len(ddl.split(","))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        spark.createDataFrame(full, ddl).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return folder

    return make

"""Session, scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def build_session(app: str = "mnemoria", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one machine, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemoria-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing being read is overwritten."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The files outlive any executor and end the lineage; later reads take only the columns they need.
    """
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({c: F.col(c).cast("string") for c in untyped}) if untyped else df
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


cut_lineage = stored

_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch sent to a Python worker. A worker holds a batch several times over, and long texts fill it.
BATCH_BYTES, BATCH_DEFAULT = "16m", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need not have it installed.

    Arrow batches of this session are kept small as well, unless their size has been set.
    """
    context = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, BATCH_DEFAULT) in (None, BATCH_DEFAULT):
        spark.conf.set(key, BATCH_BYTES)
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "mnemoria_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)

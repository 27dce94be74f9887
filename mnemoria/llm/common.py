"""Shared pieces: words, shared-folder tables, the package on the workers, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoria.runtime import ship_package, stored  # noqa: F401  (for the operators)

#: White space is ASCII white space everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; an input column of the same name, in any letter case, is replaced."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def in_training(doc_id: Column | str) -> Column:
    """The labelled rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1 (null ids: not)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def held_out(doc_id: Column | str) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def hash_share(*columns: Column | str) -> Column:
    """A number in [0, 1) fixed by the values, for samples and rounding that reruns and retries repeat."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))

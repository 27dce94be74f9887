"""A corpus pipeline over ``documents``: stages that each read what the stage before them kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemoria.llm.common import documents, stored
from mnemoria.llm.language_id import identify, train
from mnemoria.llm.line_dedup import without_repeated_lines
from mnemoria.llm.mixing import mixed
from mnemoria.llm.packing import packed_documents
from mnemoria.llm.simhash import WIDE, Settings, one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go (null or letterless texts, and low scores)."""
    return identify(docs, train(docs)).where("NOT rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of a line, up to two edits, are cut out; documents left without a word by that go, and whole copies."""
    return without_repeated_lines(docs, keep_short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints (four bits), or similar to 0.8 or more over five-word shingles, one of each group stays."""
    return one_of_each(docs, settings=(Settings(), WIDE))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated, or left out, so that sources come to their target weights in words."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their bucket, batch and slot, by tokens."""
    return packed_documents(docs)


STAGES = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing),
]
#: The stages rest on trained weights, hashes and draws that SQL has no equal for; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

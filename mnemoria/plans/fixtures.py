"""The test tables seen as a memory corpus. Every view reads its whole source table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoria.functions import scoring, text
from mnemoria.model import ENTITY_KINDS, LAYERS, SCHEMAS, Store, make_store
from mnemoria.operators.ingest import encode_texts, keyword_encoder
from mnemoria.runtime import scratch_path, ship_package
from mnemoria.scale import spread

AS_OF = 1_706_745_600
MODEL, DIM = "m64", 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables of long texts, with their unique key.
TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a text table, on all cores."""
    return spread(table(spark, sf_dir, name).select(*columns), *TEXT_KEYS[name])


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _source_number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)$", 1).cast("bigint")


def v_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    n = names.withColumn("id", _source_number(F.col("source")) + 1)
    return n.select(
        "id",
        _pick(ENTITY_KINDS, F.col("id") % 6).alias("kind"),
        F.col("source").alias("name"),
        text.normalize_name(F.col("source")).alias("normalized_name"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("key:"), "source")).alias("canonical_key"),
        ((F.col("id") * 7 % 100) / 10.0).alias("momentum_score"),
        F.lit(AS_OF - 7200).cast("bigint").alias("momentum_at"),
        (F.lit(AS_OF) - F.col("id") * 5 * scoring.DAY).alias("created_at"),
        F.lit(AS_OF).cast("bigint").alias("updated_at"),
    )


def v_memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id")
    if vectors:
        known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        rows = rows.join(known, "id", "left")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    i = F.col("id")
    layer = _pick(LAYERS, i % 6)
    importance = F.coalesce(F.col("quality") * 0.5 + 0.25, i % 11 / 10.0)
    created = F.lit(AS_OF) - i % 120 * scoring.DAY
    gone = (i % 29 == 0) | (i % 31 == 0)
    rows = rows.withColumns({"layer": layer, "importance": importance, "created_at": created})
    return rows.select(
        "id",
        (_source_number(F.col("source")) + 1).alias("entity_id"),
        "layer",
        F.col("text").alias("content"),
        "importance",
        ((F.col("importance") >= 0.9) | (F.col("layer") == "realize")).alias("protected"),
        F.format_string('{"session_id":"c%d","kind":"note"}', i % 100).alias("source"),
        "created_at",
        (F.lit(AS_OF) - i % 97 * scoring.DAY).alias("last_accessed_at"),
        (i % 13).cast("int").alias("access_count"),
        F.when(gone, F.lit(AS_OF - scoring.DAY).cast("bigint")).alias("archived_at"),
        F.when(i % 31 == 0, i + 1).alias("superseded_by_id"),
        F.lit(None).cast("double").alias("supersession_confidence"),
        scoring.default_expiry(F.col("layer"), F.col("created_at")).alias("expires_at"),
        "embedding",
        F.when(i % 7 == 0, "old-model").otherwise(MODEL).alias("embedding_model"),
        F.when(i % 10 == 0, "pending").otherwise("done").alias("embedding_status"),
        F.lit(DIM).alias("embedding_dim"),
        F.when(i % 17 != 0, text.tokenized(F.col("text"))).alias("content_tokenized"),
        F.when(i % 5 != 0, (i % 10 + 1) / 10.0).alias("activation_score"),
        F.when(i % 5 != 0, (i % 3 + 1) / 3.0).alias("ttl_penalty"),
        F.when(i % 5 != 0, F.lit(1.0)).alias("supersession_penalty"),
        F.when(i % 5 != 0, F.lit(AS_OF) - i % 40 * 60).alias("activation_computed_at"),
    )


def stored_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories with tokens and vectors as a written table, as a store keeps them: written by each query that asks."""
    path = scratch_path(spark, "memories")
    v_memories(spark, sf_dir, vectors=True).write.parquet(path)
    return spark.read.schema(SCHEMAS["memories"]).parquet(path)


def v_doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with the offline encoder's counts of their whole text, which floats hold exactly; exact and near copies exist."""
    memories = v_memories(spark, sf_dir).drop("embedding")
    body = F.coalesce("content_tokenized", text.tokenized(F.col("content")))
    vectors = encode_texts(memories.select("id", body.alias("body")), lambda: keyword_encoder(DIM, unit=False))
    return memories.join(vectors.select("id", F.col("vec").cast("array<float>").alias("embedding")), "id")


def v_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("id"), F.col("label").cast("bigint").alias("entity_id"), F.lit("context").alias("layer"),
        F.lit("").alias("content"), "embedding", F.lit(MODEL).alias("embedding_model"),
        F.lit("done").alias("embedding_status"), F.lit(DIM).alias("embedding_dim"),
        (F.lit(AS_OF) - i % 100 * scoring.DAY).alias("created_at"),
        F.lit(None).cast("bigint").alias("archived_at"), F.lit(None).cast("bigint").alias("superseded_by_id"),
    )


def v_access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), F.unix_timestamp("ts").alias("accessed_at")
    )


def v_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"),
        F.col("props").alias("payload"), F.unix_timestamp("ts").alias("occurred_at"),
    )


def v_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event users as entities, for momentum."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return users.withColumn("created_at", F.lit(AS_OF) - (F.col("id") % 60) * scoring.DAY)


def v_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    joined = lines.join(parts, "l_partkey")
    flag = F.col("l_returnflag")
    return joined.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("s"), F.col("l_orderkey")).alias("session_id"),
        F.col("l_suppkey").alias("memory_id"),
        F.concat_ws("/", F.lit("/work"), "p_brand", F.concat(F.translate("p_name", " ", "_"), F.lit(".py"))).alias("file_path"),
        F.when(flag == "A", "edit").when(flag == "R", "write").otherwise("read").alias("operation"),
        F.concat(F.lit("t"), F.col("l_linenumber")).alias("turn_uuid"),
        F.concat(F.lit("change "), F.lower("p_type"), F.lit(" "), "p_name").alias("context_snippet"),
        (F.unix_timestamp("l_shipdate") + F.col("l_linenumber") * 4).alias("occurred_at"),
    )


# What some turns say or begin with, so that each rule about turns has rows: by (31 * conversation + turn) % 23.
TURN_CASES = {
    0: "/compact {}", 1: "<system-reminder>{}", 2: "ok", 3: "", 4: "no", 5: "{} PostToolUse:Write hook", 6: " Yes ",
    7: "Please never commit secrets to the repository. {}", 8: "We decided to use the second design. {}",
}
SCHEDULED = '<scheduled-task name="nightly">'


def _turn_text() -> Column:
    """The text of a turn with its case; in every 17th conversation a schedule speaks for the user."""
    number = (F.col("conv_id") * 31 + F.col("turn")) % 23
    said = F.col("text")
    for case, form in TURN_CASES.items():
        before, _, after = form.partition("{}")
        value = F.concat(F.lit(before), F.col("text"), F.lit(after)) if "{}" in form else F.lit(form)
        said = F.when(number == case, value).otherwise(said)
    scheduled = (F.col("conv_id") % 17 == 0) & (F.col("role") == "user")
    return F.when(scheduled, F.concat(F.lit(SCHEDULED), F.col("text"))).otherwise(said)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return rows.withColumn("text", _turn_text())


def v_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = "array<struct<name:string,input:string,id:string>>"
    return _turns(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("session_id"), F.col("turn").alias("seq"),
        F.concat_ws("-", "conv_id", "turn").alias("uuid"), "role",
        (F.lit(AS_OF) + F.col("turn") * 60).alias("ts"), "text",
        F.lit(None).cast(calls).alias("tool_calls"), F.lit(False).alias("has_tool_result"), F.lit(0).alias("errors"),
    )


def v_transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript lines: assistant turns edit a file, user turns are plain text."""
    turns = _turns(spark, sf_dir)
    path = F.format_string("/home/dev/proj%d/src/f%d.py", F.col("conv_id") % 5, F.col("turn") % 3)
    call = F.struct(
        F.lit("tool_use").alias("type"), F.lit("Edit").alias("name"),
        F.struct(path.alias("file_path"), F.substring("text", 1, 40).alias("old_string"), F.col("text").alias("new_string")).alias("input"),
        F.concat(F.lit("u"), F.col("turn")).alias("id"),
    )
    said = F.struct(F.lit("text").alias("type"), F.col("text"))
    blocks = F.concat(F.lit("["), F.to_json(said), F.lit(","), F.to_json(call), F.lit("]"))
    plain = F.get(F.regexp_extract_all(F.to_json(F.struct(F.col("text"))), F.lit(r'^\{"text":(.*)\}$'), F.lit(1)), F.lit(0))
    content = F.when(F.col("role") == "assistant", blocks).otherwise(plain)
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('","uuid":"'), F.concat_ws("-", "conv_id", "turn"),
        F.lit('","timestamp":"'), text.iso_instant(F.lit(AS_OF) + F.col("turn") * 60),
        F.lit('","cwd":"/home/dev/start","sessionId":"c'), F.col("conv_id"),
        F.lit('","gitBranch":"main","message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}"),
    )
    return turns.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit(".jsonl")).alias("file"), F.lit(0).cast("bigint").alias("block"),
        F.col("turn").alias("row"), line.alias("line"),
    )


def write_transcripts(lines: DataFrame, folder: str) -> None:
    """Transcript lines as text files, one per session, in folders of 64 buckets of sessions."""
    bucket = F.pmod(F.xxhash64("file"), F.lit(64)).alias("bucket")
    session = F.regexp_replace("file", r"\.jsonl$", "").alias("session")
    rows = lines.select(bucket, session, "row", F.coalesce("line", F.lit("")).alias("line"))
    rows = rows.repartition("session").sortWithinPartitions("session", "row")
    try:
        files, root = fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError):
        # Only Hadoop knows this file system. The text sink writes a file per folder, so each session gets one of its own.
        sink = rows.select("bucket", "session", "line").write.partitionBy("bucket", "session")
        sink.option("compression", "none").text(folder)
        return

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        part = f"_{uuid.uuid4().hex}"
        name = out = None
        done = 0

        def finish() -> None:
            # A file has its name once it is whole, so that a repeated task leaves no half of one.
            if out is not None:
                out.close()
                files.move(f"{root}/{part}", f"{root}/{name}.txt")

        for batch in batches:
            for (place, own), said in batch.groupby(["bucket", "session"], sort=False)["line"]:
                if name != f"bucket={place}/{own}":
                    finish()
                    name, done = f"bucket={place}/{own}", done + 1
                    files.create_dir(f"{root}/bucket={place}")
                    out = files.open_output_stream(f"{root}/{part}")
                out.write("".join(f"{line}\n" for line in said).encode())
        finish()
        yield pd.DataFrame({"files": [done]})

    ship_package(lines.sparkSession)
    files.create_dir(root)
    rows.mapInPandas(written, "files bigint").agg(F.sum("files")).collect()


# Spellings of the layers in queries, in the order of LAYERS.
SPELLINGS = ["targets", "Situation", "mood", " how ", "Warnings", "decisions"]


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query; some name a layer, some an entity."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    i = F.col("item_id")
    return items.join(vectors, "item_id", "left").select(
        i.cast("string").alias("query_id"), "text", "vec",
        F.when(i % 8 == 2, _pick(LAYERS, i % 6)).when(i % 8 == 6, _pick(SPELLINGS, i % 6)).when(i % 8 == 1, "nowhere").alias("layer"),
        F.when(i % 4 == 3, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("entity_name"),
        F.when(i % 2 == 0, "en").otherwise("code").alias("lang"),
    )


def v_files(spark: SparkSession, sf_dir: str, version: int = 1, suffix: str = ".txt") -> DataFrame:
    """Documents as files; in version 2 some are edited, some only touched."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    i = F.col("doc_id")
    content = F.col("text")
    mtime = F.lit(AS_OF).cast("bigint")
    if version == 2:
        content = F.when(i % 3 == 0, F.concat(F.lit("edited "), content, F.lit("\nlast line"))).otherwise(content)
        mtime = mtime + i % 2
    return docs.select(
        F.concat(F.lit("doc/"), i, F.lit(suffix)).alias("path"), mtime.alias("mtime"),
        F.octet_length(content).cast("bigint").alias("size_bytes"), content.alias("content"),
    )


def v_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files in which every line but the first is a heading."""
    files = v_files(spark, sf_dir, suffix=".md")
    return files.withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n## ")))


def v_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python files in which every line but the first begins a class or a function."""
    even = F.regexp_extract("path", r"(\d+)\.py$", 1).cast("bigint") % 2 == 0
    start = F.when(even, "\nclass Part: # ").otherwise("\nasync def run(): # ")
    return v_files(spark, sf_dir, suffix=".py").withColumn("content", F.replace("content", F.lit("\n"), start))


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "url", "html").select(
        F.col("url").alias("path"), F.lit(AS_OF).cast("bigint").alias("mtime"),
        F.octet_length("html").cast("bigint").alias("size_bytes"), F.col("html").alias("content"),
    )


def v_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curated note files with frontmatter."""
    i = F.col("doc_id")
    kind = _pick(["feedback", "user", "project", "reference", "misc"], i % 5)
    head = F.concat(F.lit("---\nname: note-"), i, F.lit("\ndescription: about "), "source")
    typed = F.when(i % 2 == 0, F.concat(F.lit("\ntype: "), kind)).otherwise(F.concat(F.lit("\nmetadata:\n  type: "), kind))
    return texts(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        F.concat(F.lit("/notes/"), "source", F.lit("/memory/n"), i, F.lit(".md")).alias("path"),
        F.concat(head, typed, F.lit("\n---\n"), "text").alias("raw"),
    )


def v_store(spark: SparkSession, sf_dir: str, memories: DataFrame | None = None, vectors: bool = False) -> Store:
    return make_store(
        spark,
        entities=v_entities(spark, sf_dir),
        memories=memories if memories is not None else stored_memories(spark, sf_dir) if vectors else v_memories(spark, sf_dir),
        access_log=v_access_log(spark, sf_dir),
        events=v_events(spark, sf_dir),
        file_edits=v_edits(spark, sf_dir),
    )

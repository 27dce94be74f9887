"""Chunking of versioned text and change detection between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.functions import text

# Window size, token cost of a reply's envelope, chunk boundaries.
WINDOW_LINES, ENVELOPE_TOKENS = 100, 80
HEADING = r"^#{2,3}\s+(.+?)\s*$"
PYTHON_TOP = r"^(async\s+def|def|class)\s+(\w+)"
MARK = "struct<start:int,id:string,kind:string>"


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def content_hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def chunk_documents(files: DataFrame) -> DataFrame:
    """(path, content) -> path, id, kind, start_line, end_line, hash, content.

    A file is cut inside its own row, so chunking adds no shuffle.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    lines = F.split("content", "\n")
    cut = files.select("path", lines.alias("lines"), extension.alias("ext"))
    numbered = F.transform("lines", lambda line, i: F.struct((i + 1).alias("start"), line.alias("line")))

    def marks(pattern: str, id_column, kind_column) -> Column:
        return F.transform(
            F.filter(numbered, lambda x: x["line"].rlike(pattern)),
            lambda x: F.struct(x["start"].alias("start"), id_column(x["line"]).alias("id"), kind_column(x["line"]).alias("kind")),
        )

    def python_kind(line: Column) -> Column:
        return F.when(F.regexp_extract(line, PYTHON_TOP, 1) == "class", "python_class").otherwise("python_def")

    found = (
        F.when(
            F.col("ext").isin("md", "markdown"),
            marks(HEADING, lambda x: F.concat(F.lit("heading:"), F.regexp_extract(x, HEADING, 1)), lambda x: F.lit("heading")),
        )
        .when(
            F.col("ext") == "py",
            marks(PYTHON_TOP, lambda x: F.concat(python_kind(x), F.lit(":"), F.regexp_extract(x, PYTHON_TOP, 2)), python_kind),
        )
        .otherwise(F.array().cast(f"array<{MARK}>"))
    )
    marked = cut.withColumn("marks", found).withColumn("n", F.size("lines"))
    first = F.get("marks", F.lit(0))["start"]
    head = F.array_join(F.slice("lines", F.lit(1), F.greatest(first - 1, F.lit(0))), "\n")
    has_preamble = (first > 1) & (text.strip(head) != "")
    is_python = F.col("ext") == "py"
    preamble = F.array(
        F.struct(
            F.lit(1).alias("start"),
            F.when(is_python, "python_preamble").otherwise("heading:_preamble").alias("id"),
            F.when(is_python, "python_preamble").otherwise("heading").alias("kind"),
        )
    ).cast(f"array<{MARK}>")
    marked = marked.withColumn("marks", F.when(has_preamble, F.concat(preamble, F.col("marks"))).otherwise(F.col("marks")))
    named = F.transform(
        "marks",
        lambda m, i: F.struct(
            m["id"].alias("id"),
            m["kind"].alias("kind"),
            m["start"].alias("start_line"),
            F.coalesce(F.get("marks", i + 1)["start"] - 1, F.col("n")).alias("end_line"),
        ),
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.col("n"), F.lit(WINDOW_LINES)),
        lambda s: F.struct(
            F.concat(F.lit("lines:"), s, F.lit("_"), F.least(s + WINDOW_LINES - 1, F.col("n"))).alias("id"),
            F.lit("fixed").alias("kind"),
            s.alias("start_line"),
            F.least(s + WINDOW_LINES - 1, F.col("n")).alias("end_line"),
        ),
    )
    spans = marked.select("path", "lines", F.explode(F.when(F.size("marks") > 0, named).otherwise(windows)).alias("c"))
    body = F.array_join(
        F.slice("lines", F.col("c.start_line"), F.col("c.end_line") - F.col("c.start_line") + 1), "\n"
    )
    return spans.select(
        "path", "c.id", "c.kind", "c.start_line", "c.end_line", body.alias("content")
    ).withColumn("hash", short_hash(F.col("content")))


def chunk_diff(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, id, status, ...) between stored chunk rows and new ones: added, modified, unchanged, removed.

    A new chunk is held against the last stored one of its id; every stored chunk whose id is gone is told.
    """
    old = stored.groupBy("path", "id").agg(F.max_by(F.col("hash"), "start_line").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("hash") != F.col("old_hash"), "modified").otherwise("unchanged")
    )
    met = chunks.join(old, ["path", "id"], "left").select(
        "path", "id", status.alias("status"), "start_line", "end_line",
        F.when(status.isin("added", "modified"), F.col("content")).alias("content"),
    )
    gone = stored.join(chunks.select("path", "id"), ["path", "id"], "left_anti")
    return met.unionByName(
        gone.select("path", "id", F.lit("removed").alias("status"), "start_line", "end_line", F.lit(None).cast("string").alias("content"))
    )


def stored_chunks(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("path", F.explode("chunks").alias("c")).select(
        "path", "c.id", "c.kind", "c.start_line", "c.end_line", "c.hash"
    )


def read_status(snapshots: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Files with their status; the content hash is taken only where the time differs."""
    before = snapshots.select("path", F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    joined = files.join(before, "path", "left")
    if force:
        status = F.when(F.col("old_hash").isNull(), "first_read").otherwise("forced_full")
    else:
        status = (
            F.when(F.col("old_hash").isNull(), "first_read")
            .when(F.col("old_mtime") == F.col("mtime"), "unchanged")
            .when(content_hash(F.col("content")) == F.col("old_hash"), "unchanged_content")
            .otherwise("modified")
        )
    return joined.withColumn("status", status).drop("old_mtime", "old_hash")


def detect_changes(snapshots: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """One row per file: status, changed, unchanged and removed chunks, and the tokens saved.

    ``files(path, mtime, size_bytes, content)``. Only modified files are chunked and compared.
    """
    judged = read_status(snapshots, files, force)
    modified = judged.filter(F.col("status") == "modified").select("path", "content")
    stored = stored_chunks(snapshots.join(modified.select("path"), "path", "left_semi"))
    diff = chunk_diff(stored, chunk_documents(modified))
    is_changed = F.col("status").isin("added", "modified")
    per_path = diff.groupBy("path").agg(
        F.sum(F.when(is_changed, 1).otherwise(0)).alias("changed"),
        F.sum(F.when(F.col("status") == "unchanged", 1).otherwise(0)).alias("unchanged"),
        F.sum(F.when(F.col("status") == "removed", 1).otherwise(0)).alias("removed"),
        F.sum(F.when(is_changed, text.token_estimate(F.col("content"))).otherwise(0)).alias("sent"),
    )
    sized = judged.select("path", "status", "size_bytes", text.token_estimate(F.col("content")).alias("tokens_full"))
    joined = sized.join(per_path, "path", "left")
    by_size = F.round(F.col("size_bytes") * 0.3).cast("bigint")
    returned = F.when(F.col("status") == "modified", F.col("sent") + ENVELOPE_TOKENS)
    saved = (
        F.when(F.col("status").isin("unchanged", "unchanged_content"), by_size)
        .when(F.col("status") == "modified", F.greatest(F.lit(0), F.col("tokens_full") - returned))
        .otherwise(F.lit(0))
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "path", "status", F.coalesce("changed", zero).alias("changed"), F.coalesce("unchanged", zero).alias("unchanged"),
        F.coalesce("removed", zero).alias("removed"), "tokens_full", returned.cast("bigint").alias("tokens_returned"),
        saved.cast("bigint").alias("tokens_saved"),
    )


def reread_savings(changes: DataFrame) -> DataFrame:
    """Savings of modified files per path, and in total under the path ``*``."""
    modified = changes.filter(F.col("status") == "modified")
    both = modified.withColumn("path", F.explode(F.array(F.col("path"), F.lit("*"))))
    summed = both.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in ("tokens_full", "tokens_returned", "tokens_saved")]
    )
    pct = F.when(F.col("tokens_full") > 0, F.round(F.col("tokens_saved") / F.col("tokens_full") * 100)).otherwise(0)
    return summed.withColumn("pct_saved", pct.cast("bigint"))


def snapshot_rows(files: DataFrame, read_at: int) -> DataFrame:
    """Snapshot columns of files just read, ready for upsert_file_snapshots."""
    chunks = chunk_documents(files.select("path", "content"))
    # The chunk list of one file, as in the stored schema.
    listed = chunks.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("start_line", "id", "kind", "end_line", "hash"))).alias("rows")
    )
    ordered = F.transform("rows", lambda r: F.struct(r["id"], r["kind"], r["start_line"], r["end_line"], r["hash"]))
    return files.join(listed, "path").select(
        "path", content_hash(F.col("content")).alias("content_hash"), "mtime", "size_bytes", ordered.alias("chunks"),
        F.lit(read_at).cast("bigint").alias("read_at"),
    )


def upsert_file_snapshots(prev: DataFrame, reads: DataFrame) -> DataFrame:
    """Insert or replace by path. A read with a null hash is a touch: it may only refresh the time."""
    put_at = F.when(F.col("content_hash").isNotNull(), F.col("read_at"))
    per_path = reads.groupBy("path").agg(
        F.count("*").cast("int").alias("reads"),
        F.max("read_at").alias("read_at"),
        F.max_by(F.struct("content_hash", "size_bytes", "chunks"), put_at).alias("put"),
        F.max_by("mtime", F.when(F.col("mtime").isNotNull(), F.col("read_at"))).alias("new_mtime"),
    )
    joined = prev.join(per_path, "path", "full_outer").filter(F.col("read_count").isNotNull() | F.col("put").isNotNull())
    return joined.select(
        "path",
        F.coalesce("put.content_hash", "content_hash").alias("content_hash"),
        F.coalesce("new_mtime", "mtime").alias("mtime"),
        F.coalesce("put.size_bytes", "size_bytes").alias("size_bytes"),
        F.coalesce("put.chunks", "chunks").alias("chunks"),
        F.coalesce("read_at", "last_read_at").alias("last_read_at"),
        (F.coalesce("read_count", F.lit(0)) + F.coalesce("reads", F.lit(0))).alias("read_count"),
    )

"""Agent transcripts: JSON lines, one file per session."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoria.runtime import cut_lineage

LINE = (
    "type STRING, uuid STRING, timestamp STRING, cwd STRING, sessionId STRING, gitBranch STRING, "
    "isMeta BOOLEAN, isSidechain BOOLEAN, message STRUCT<role: STRING>"
)

TURN = ["seq", "uuid", "role", "ts", "text", "tool_calls", "tool_results", "has_tool_result", "errors"]


def read_lines(spark: SparkSession, path: str, modified_after: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """(file, block, row, line). Files stay splittable; block start and row order the lines of a file.

    ``block`` is where the line's split of the file begins, in bytes; splits are at least 1 MiB apart.
    """
    raw = spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=True, modifiedAfter=modified_after)
    return _located(raw)


def changed_lines(spark: SparkSession, path: str, since: int, until: int, glob: str = "*.jsonl") -> DataFrame:
    """As ``read_lines``, of files last changed at ``since`` or later and before ``until`` (epoch seconds), read whole."""

    def told(at: int) -> str:
        return datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")

    # Spark leaves out the time given itself, so one second more is listed, and its files are taken out again.
    raw = spark.read.option("timeZone", "UTC").text(
        path, pathGlobFilter=glob, recursiveFileLookup=True, modifiedAfter=told(max(since - 1, 0)), modifiedBefore=told(until)
    )
    return _located(raw.where(F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(since))))


def _located(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def scan_transcripts(
    spark: SparkSession, path: str, modified_after: str | None = None, glob: str = "*.jsonl"
) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) of the files below ``path`` that match ``glob``, all or those changed after a time.

    ``modified_after`` (``YYYY-MM-DDTHH:mm:ss``) finds files that have grown in place, read whole.
    """
    return parse_lines(read_lines(spark, path, modified_after, glob))


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns from (file, block, row, line).

    Lines that are not JSON are dropped. ``seq`` orders the lines of a file: its high bits number the file's split
    (by MiB), its low 33 bits the row in the split, so nothing is sorted for it.
    """
    docs = (
        lines.withColumn("doc", F.try_parse_json("line"))
        .filter(F.col("doc").isNotNull())
        .withColumn("e", F.from_json("line", LINE))
    )
    content = F.try_variant_get("doc", "$.message.content", "variant")
    seconds = F.coalesce(F.try_to_timestamp("e.timestamp").cast("bigint"), F.lit(0))
    flat = docs.select(
        "file", "block", "row",
        F.col("e.type").alias("type"), F.coalesce("e.uuid", F.lit("")).alias("uuid"), seconds.alias("ts"),
        F.col("e.cwd").alias("cwd"), F.col("e.sessionId").alias("sid"), F.col("e.gitBranch").alias("branch"),
        (F.coalesce("e.isMeta", F.lit(False)) | F.coalesce("e.isSidechain", F.lit(False))).alias("hidden"),
        F.col("e.message.role").alias("role"),
        F.try_variant_get("doc", "$.message.content", "string").alias("raw"),
        F.coalesce(F.schema_of_variant(content) == "STRING", F.lit(False)).alias("plain"),
    )
    low = F.lit((1 << 33) - 1)
    seq = F.shiftleft(F.shiftright("block", 20), 33) + F.col("row").bitwiseAND(low)
    is_turn = F.col("type").isin("user", "assistant") & ~F.col("hidden") & F.col("role").isin("user", "assistant")
    told = flat.withColumn("seq", seq).withColumn("is_turn", F.coalesce(is_turn, F.lit(False)))
    # Files are opened and lines parsed once; what follows reads the columns it needs. Thousands of short files make many
    # tasks of a few lines each, so the parsed lines are dealt anew to files of even size.
    parsed = _turn_columns(told.withColumn("raw", F.when(F.col("is_turn"), F.col("raw"))))
    placed = cut_lineage(parsed.hint("rebalance", "file"), "transcript-lines")
    turns = placed.filter("is_turn").select("file", *TURN)

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name) != "", F.col("seq")))

    real = F.when(F.col("ts") > 0, F.col("ts"))
    heads = placed.groupBy("file").agg(
        first("sid").alias("session_id"), first("cwd").alias("project_cwd"), first("branch").alias("git_branch"),
        F.coalesce(F.min(real), F.lit(0)).alias("started_at"), F.coalesce(F.max(real), F.lit(0)).alias("ended_at"),
    )
    counts = turns.groupBy("file").agg(
        F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("turns_user"),
        F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("turns_assistant"),
        F.sum("errors").alias("errors"),
    )
    sessions = (
        heads.filter(F.col("session_id").isNotNull())
        .join(counts, "file")
        .withColumn("project_cwd", F.coalesce("project_cwd", F.lit("(unknown)")))
    )
    # A session imported from two files keeps the later one, as a re-import would.
    latest = sessions.groupBy("session_id").agg(F.max("file").alias("file"))
    sessions = sessions.join(latest, ["session_id", "file"], "left_semi")
    owned = turns.join(sessions.select("file", "session_id"), ["file"])
    return sessions, owned.drop("file")


def _turn_columns(turns: DataFrame) -> DataFrame:
    blocks = F.when(~F.col("plain"), F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>"))

    def field(block: Column, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(block, f"$.{name}", kind)

    def is_text(block: Column) -> Column:
        return F.schema_of_variant(block) == "STRING"

    def of_type(name: str) -> Column:
        return F.coalesce(F.filter("blocks", lambda b: F.coalesce(field(b, "type") == name, F.lit(False))), F.array().cast("array<variant>"))

    spoken = F.filter(
        F.transform(
            "blocks",
            lambda b: F.when(is_text(b), F.try_variant_get(b, "$", "string")).when(field(b, "type") == "text", field(b, "text")),
        ),
        lambda s: s.isNotNull(),
    )
    calls = F.transform(
        of_type("tool_use"),
        lambda b: F.struct(
            field(b, "name").alias("name"),
            F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("input"),
            field(b, "id").alias("id"),
        ),
    )

    def output(block: Column) -> Column:
        inner = F.try_variant_get(block, "$.content", "array<variant>")
        parts = F.transform(
            inner,
            lambda c: F.when(is_text(c), F.try_variant_get(c, "$", "string")).otherwise(F.coalesce(field(c, "text"), F.lit(""))),
        )
        plain = is_text(F.try_variant_get(block, "$.content", "variant"))
        return F.substring(F.when(plain, field(block, "content")).otherwise(F.coalesce(F.array_join(parts, "\n"), F.lit(""))), 1, 300)

    results = F.transform(
        of_type("tool_result"),
        lambda b: F.struct(
            field(b, "tool_use_id").alias("tool_use_id"),
            F.coalesce(field(b, "is_error", "boolean"), F.lit(False)).alias("is_error"),
            output(b).alias("output_preview"),
        ),
    )
    is_user = F.col("role") == "user"
    return (
        turns.withColumn("blocks", blocks)
        .withColumn("text", F.when(F.col("plain"), F.col("raw")).otherwise(F.coalesce(F.array_join(spoken, "\n"), F.lit(""))))
        .withColumn("tool_calls", F.when(~is_user, calls))
        .withColumn("tool_results", F.when(is_user, results))
        .withColumn("has_tool_result", F.coalesce(F.size("tool_results") > 0, F.lit(False)))
        .withColumn("errors", F.coalesce(F.size(F.filter("tool_results", lambda r: r["is_error"])), F.lit(0)))
        .select("file", "sid", "cwd", "branch", "is_turn", *TURN)
    )

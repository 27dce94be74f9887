"""Curated Markdown notes with a small frontmatter block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemoria.functions.redact import redacted
from mnemoria.functions.text import strip

INDEX_FILE = "MEMORY.md"
KEY_LINE = r"^\s*([A-Za-z_][\w-]*)\s*:\s*(.*)$"


def scan_curated_notes(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Notes below ``path`` (any ``memory/*.md``). A note is one small file, hence one row. ``most`` as for ``parse_notes``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.[mM][dD]", recursiveFileLookup=True)
    return parse_notes(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")), most)


def parse_notes(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, raw) -> one row per usable note: name, description, type, body, layer, importance, content.

    ``content`` is the whole note, or its first ``most`` characters.
    """
    placed = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    # The index file counts only where it is the sole note of its folder: told by the paths, before any text is parsed.
    is_index = F.col("file") == INDEX_FILE
    others = placed.filter(~is_index).select("dir").distinct()
    wanted = placed.filter(~is_index).unionByName(placed.filter(is_index).join(others, "dir", "left_anti"))
    cut = F.split("raw", "\n")
    lines = F.when(F.contains("raw", F.lit("\r")), F.transform(cut, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(cut)
    parsed = wanted.withColumn("lines", lines)
    # Position (1-based) of the closing marker, 0 when there is no frontmatter.
    opens = strip(F.col("lines")[0]) == "---"
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1)))
    closing = F.array_position(F.transform(rest, lambda x: F.when(F.contains(x, F.lit("---")), strip(x)).otherwise("")), F.lit("---"))
    parsed = parsed.withColumn("end", F.when(opens & (F.size("lines") > 1), closing).otherwise(0).cast("int"))
    head = F.when(F.col("end") > 1, F.slice("lines", F.lit(2), F.col("end") - 1)).otherwise(F.array().cast("array<string>"))
    parsed = parsed.withColumn("head", head)
    body_start = F.when(F.col("end") > 0, F.col("end") + 2).otherwise(1)
    body_lines = F.when(
        body_start <= F.size("lines"), F.slice("lines", body_start, F.size("lines"))
    ).otherwise(F.array().cast("array<string>"))
    parsed = parsed.withColumn("body", strip(F.array_join(body_lines, "\n")))

    entries = F.transform(
        F.filter("head", lambda x: x.rlike(KEY_LINE)),
        lambda x: F.struct(
            x.rlike(r"^\s").alias("inner"),
            F.regexp_extract(x, KEY_LINE, 1).alias("key"),
            _unquote(F.regexp_extract(x, KEY_LINE, 2)).alias("value"),
        ),
    )
    parsed = parsed.withColumn("entries", entries)
    # An indented `type` counts only while the last flat key above it is `metadata`.
    tagged = F.transform(
        "entries",
        lambda e, i: F.struct(
            e["inner"].alias("inner"),
            e["key"].alias("key"),
            e["value"].alias("value"),
            F.element_at(
                F.concat(
                    F.array(F.lit("")),
                    F.transform(F.filter(F.slice("entries", F.lit(1), i + 1), lambda p: ~p["inner"]), lambda p: p["key"]),
                ),
                -1,
            ).alias("under"),
        ),
    )
    parsed = parsed.withColumn("entries", tagged)

    def flat(key: str) -> Column:
        return _last(F.filter("entries", lambda e: ~e["inner"] & (e["key"] == key)))

    kind = _last(
        F.filter(
            "entries",
            lambda e: (e["key"] == "type") & (~e["inner"] | (e["under"] == "metadata")),
        )
    )
    columns = {
        "path": F.col("path"),
        "dir": F.col("dir"),
        "file": F.col("file"),
        "name": F.coalesce(F.nullif(flat("name"), F.lit("")), F.regexp_replace("file", r"(?i)\.md$", "")),
        "description": F.coalesce(flat("description"), F.lit("")),
        "type": F.nullif(kind, F.lit("")),
        "origin_session_id": F.nullif(flat("originSessionId"), F.lit("")),
        "body": F.col("body"),
    }
    # One row by ``inline``: a filter on a parsed column does not go below it, where the parsing would be done again for it.
    named = parsed.select(F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    kept = named.filter((F.col("body") != "") | (F.col("description") != ""))

    lowered = F.lower("type")
    content = F.concat(
        F.lit("# "),
        F.col("name"),
        F.when(F.col("description") != "", F.concat(F.lit("\n"), F.col("description"))).otherwise(""),
        F.when(F.col("body") != "", F.concat(F.lit("\n\n"), F.col("body"))).otherwise(""),
    )
    return kept.select(
        "path", "dir", "file", "name", "description", "type", "origin_session_id", "body",
        # Layer and importance by note type.
        F.when(lowered == "feedback", "learning").otherwise("context").alias("layer"),
        F.when(lowered == "feedback", 0.7).when(lowered.isin("user", "project", "reference"), 0.6).otherwise(0.5).alias("importance"),
        redacted(strip(content) if most is None else F.substring(strip(content), 1, most)).alias("content"),
    )


def _unquote(value: Column) -> Column:
    v = strip(value)
    return F.when(
        (F.char_length(v) >= 2) & v.rlike("^(\".*\"|'.*')$"), v.substr(F.lit(2), F.char_length(v) - 2)
    ).otherwise(v)


def _last(entries: Column) -> Column:
    return F.when(F.size(entries) > 0, F.element_at(entries, -1)["value"])

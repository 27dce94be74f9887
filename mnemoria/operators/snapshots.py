"""Working-state snapshots: the few most telling rows of a session in a small byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.functions import text
from mnemoria.functions.scoring import DAY
from mnemoria.model import Store
from mnemoria.sources.store import session_of

# Budget, row limits, clip length, lifetime; tiers from most to least lasting.
BUDGET_BYTES, MAX_FILES, MAX_ITEMS, CLIP, TTL_DAYS = 2048, 10, 5, 160, 14
HEADING = "## Working state (restored)"
TIERS = [("files", "Active files"), ("realize", "Unresolved errors"), ("goal", "Goals"), ("learning", "Recent decisions")]


def snapshot_inputs(store: Store) -> DataFrame:
    """(session_id, tier, rn, line): at most ten files and five rows per tier of each session."""
    files = store.file_edits.groupBy("session_id", "file_path").agg(
        F.count("*").alias("edits"), F.max("occurred_at").alias("last_at")
    )
    by_edits = W.partitionBy("session_id").orderBy(F.desc("edits"), F.desc("last_at"), "file_path")
    top_files = files.withColumn("rn", F.row_number().over(by_edits)).filter(F.col("rn") <= MAX_FILES)
    file_lines = top_files.select(
        "session_id", F.lit("files").alias("tier"), "rn",
        F.format_string("- %s (%d edits)", "file_path", "edits").alias("line"),
    )
    notes = (
        store.memories.filter(F.col("layer").isin("realize", "goal", "learning") & F.col("archived_at").isNull())
        .withColumn("session_id", session_of("source"))
        .filter(F.col("session_id").isNotNull())
    )
    by_importance = W.partitionBy("session_id", "layer").orderBy(F.desc("importance"), F.desc("id"))
    top_notes = notes.withColumn("rn", F.row_number().over(by_importance)).filter(F.col("rn") <= MAX_ITEMS)
    flat = text.collapse(F.col("content"))
    clipped = F.when(F.char_length(flat) > CLIP, F.concat(F.substring(flat, 1, CLIP), F.lit("…"))).otherwise(flat)
    note_lines = top_notes.select("session_id", F.col("layer").alias("tier"), "rn", F.concat(F.lit("- "), clipped).alias("line"))
    return file_lines.unionByName(note_lines)


def snapshot_tiers(store: Store, budget: int = BUDGET_BYTES) -> DataFrame:
    """(session_id, snapshot_text) within ``budget`` bytes, as expressions over one bounded row per session.

    Over budget, the decisions go first, as a whole. Then rows go one by one: goals, errors down
    to one, files down to one. The first number of removed rows that fits is taken.
    """
    lists = snapshot_inputs(store).groupBy("session_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("tier") == key, F.struct("rn", "line")))), lambda r: r["line"]
            ).alias(key)
            for key, _ in TIERS
        ]
    )
    files, errors, goals = (F.size(key) for key in ("files", "realize", "goal"))
    spare_errors, spare_files = F.greatest(errors - 1, F.lit(0)), F.greatest(files - 1, F.lit(0))

    def kept(removed: Column) -> dict[str, Column]:
        beyond_goals = F.greatest(removed - goals, F.lit(0))
        beyond_errors = F.greatest(beyond_goals - spare_errors, F.lit(0))
        return {
            "files": files - F.least(beyond_errors, spare_files),
            "realize": errors - F.least(beyond_goals, spare_errors),
            "goal": goals - F.least(removed, goals),
        }

    def size(rows: dict[str, Column]) -> Column:
        total = F.lit(len(HEADING.encode()))
        for key, name in TIERS:
            if key in rows:
                lines = F.aggregate(
                    F.slice(key, F.lit(1), rows[key]), F.lit(0), lambda n, line: n + F.octet_length(line) + 1
                )
                total = total + F.when(rows[key] > 0, lines + len(f"### {name}".encode()) + 1).otherwise(0)
        return total

    whole = size({**kept(F.lit(0)), "learning": F.size("learning")})
    most = goals + spare_errors + spare_files
    fitting = F.filter(F.sequence(F.lit(0), most), lambda n: size(kept(n)) <= budget)
    removed = F.coalesce(F.get(fitting, F.lit(0)), most)
    counted = lists.withColumn("fits", whole <= budget).withColumn("removed", removed)
    chosen = kept(F.when(F.col("fits"), 0).otherwise(F.col("removed")))
    chosen["learning"] = F.when(F.col("fits"), F.size("learning")).otherwise(0)
    parts = [F.lit(HEADING)]
    for key, name in TIERS:
        lines = F.array_join(F.slice(key, F.lit(1), chosen[key]), "\n")
        parts.append(F.when(chosen[key] > 0, F.concat(F.lit(f"### {name}\n"), lines)))
    return counted.select("session_id", F.concat_ws("\n", *parts).alias("snapshot_text"))


def upsert_session_snapshots(prev: DataFrame, new: DataFrame, as_of: int) -> DataFrame:
    """Latest row per session; rows past their lifetime go when something is saved."""
    merged = prev.unionByName(new).groupBy("session_id").agg(
        F.max_by("snapshot_text", "created_at").alias("snapshot_text"), F.max("created_at").alias("created_at")
    )
    return merged.filter(F.col("created_at") >= as_of - TTL_DAYS * DAY)


def load_session_snapshots(snapshots: DataFrame, sessions: DataFrame, as_of: int) -> DataFrame:
    live = snapshots.filter(F.col("created_at") >= as_of - TTL_DAYS * DAY)
    return live.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def session_snapshot_job(store: Store, as_of: int) -> Store:
    new = snapshot_tiers(store).withColumn("created_at", F.lit(as_of).cast("bigint"))
    return store.with_(session_snapshots=upsert_session_snapshots(store.session_snapshots, new, as_of))

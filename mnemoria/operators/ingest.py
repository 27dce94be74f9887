"""Writes: entity resolution, batch ingest and edit of memories, vectors and their backlog."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.functions import scoring, text
from mnemoria.functions.redact import redacted
from mnemoria.functions.vectors import is_finite
from mnemoria.model import Store, column_names
from mnemoria.runtime import cut_lineage, ship_package
from mnemoria.scale import connected, global_positions

Encoder = Callable[[list[str]], "list[list[float] | None] | None"]

PAGE_ROWS = 200


def next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` plus ``rows``, with ids after the largest one: unique and growing within a task, but not dense.

    The rows are written first, so that every later read of the result sees the same ids.
    """
    numbered = cut_lineage(rows).withColumn("id", F.lit(next_id(table)) + F.monotonically_increasing_id())
    return table.unionByName(numbered.select([c for c in table.columns if c in numbered.columns]), allowMissingColumns=True)


def event_rows(df: DataFrame, entity_id: Column, kind: Column, payload: Column, as_of: int) -> DataFrame:
    return df.select(
        entity_id.cast("bigint").alias("entity_id"),
        kind.alias("kind"),
        payload.alias("payload"),
        F.lit(as_of).cast("bigint").alias("occurred_at"),
    )


def resolve_entities(
    incoming: DataFrame, entities: DataFrame, as_of: int, backfill_key: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Match names to entities: by key, by kind and normalised name, by kind and lower-cased name.

    ``incoming`` has ``seq, entity_kind, entity_name, entity_key``. Returns it with ``entity_id``
    and the updated entities: new ones for unmatched names, null keys and names filled in.
    Unmatched spellings of one normalised name, lower-cased name or key become one entity, named
    after the first of them by ``seq``. Only distinct names are matched; hot names cost nothing.
    """
    names = (
        incoming.groupBy("entity_kind", "entity_name", "entity_key")
        .agg(F.min("seq").alias("seq"))
        .withColumn("norm", text.normalize_name(F.col("entity_name")))
        .withColumn("lowered", F.lower("entity_name"))
    )
    normal = entities.select(F.col("kind").alias("entity_kind"), F.col("normalized_name").alias("norm"), "id")
    lower = entities.select(F.col("kind").alias("entity_kind"), F.lower("name").alias("lowered"), "id")
    keyed = entities.filter(F.col("canonical_key").isNotNull()).select(F.col("canonical_key").alias("entity_key"), "id")
    by_key = keyed.groupBy("entity_key").agg(F.min("id").alias("key_id"))
    by_norm = normal.filter("norm IS NOT NULL").groupBy("entity_kind", "norm").agg(F.min("id").alias("norm_id"))
    by_lower = lower.groupBy("entity_kind", "lowered").agg(F.min("id").alias("lower_id"))
    matched = (
        names.join(by_key, "entity_key", "left")
        .join(by_norm, ["entity_kind", "norm"], "left")
        .join(by_lower, ["entity_kind", "lowered"], "left")
        .withColumn("entity_id", F.coalesce("key_id", "norm_id", "lower_id"))
    )
    matched = cut_lineage(matched)

    # A keyless entity met under a name takes the first key it is given; later names find it by that key.
    keyless = entities.filter(F.col("canonical_key").isNull()).select(F.col("id").alias("entity_id"))
    given = (
        matched.filter(F.col("entity_key").isNotNull())
        .join(keyless, "entity_id", "left_semi")
        .groupBy("entity_id")
        .agg(F.min_by("entity_key", "seq").alias("entity_key"), F.min("seq").alias("given_at"))
        .select("entity_key", "given_at", F.col("entity_id").alias("given_id"))
    )
    if backfill_key:
        later = F.when(F.col("given_at") < F.col("seq"), F.col("given_id"))
        matched = cut_lineage(
            matched.join(given, "entity_key", "left").withColumn("entity_id", F.coalesce("entity_id", later))
        )

    missing = matched.filter(F.col("entity_id").isNull())
    groups = missing.groupBy("entity_kind", "norm").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("entity_name", "seq").alias("name"),
        F.min_by("entity_key", F.when(F.col("entity_key").isNotNull(), F.col("seq"))).alias("key"),
    )
    same_name = groups.groupBy("entity_kind", F.lower("name").alias("lowered")).agg(F.min("first_seq").alias("by_name"))
    same_key = groups.filter("key IS NOT NULL").groupBy("key").agg(F.min("first_seq").alias("by_key"))
    linked = cut_lineage(
        groups.withColumn("lowered", F.lower("name"))
        .join(same_name, ["entity_kind", "lowered"], "left")
        .join(same_key, "key", "left")
    )
    # Names may hang together over several steps (by name, then by key, and so on): all of a component are one entity.
    links = linked.select(F.col("first_seq").alias("a"), F.explode(F.array("by_name", "by_key")).alias("b"))
    roots = connected(links.filter("b IS NOT NULL")).withColumnRenamed("node", "first_seq")
    rooted = cut_lineage(linked.join(roots, "first_seq", "left").withColumn("root", F.coalesce("root", "first_seq")))
    heads = rooted.filter(F.col("root") == F.col("first_seq"))
    keys = rooted.groupBy("root").agg(
        F.min_by("key", F.when(F.col("key").isNotNull(), F.col("first_seq"))).alias("group_key")
    )
    created = global_positions(
        heads.join(keys, "root").select("root", "entity_kind", "name", "norm", "group_key"),
        ["root"], "entity_id", next_id(entities),
    )
    new_ids = rooted.join(created.select("root", "entity_id"), "root").select(
        "entity_kind", "norm", F.col("entity_id").alias("created_id")
    )
    table = matched.join(new_ids, ["entity_kind", "norm"], "left").withColumn(
        "entity_id", F.coalesce("entity_id", "created_id")
    )
    key_of_name = F.coalesce("entity_key", F.lit(""))
    lookup = table.select(
        F.col("entity_kind"), F.col("entity_name"), key_of_name.alias("__key"), "entity_id"
    )
    resolved = incoming.withColumn("__key", key_of_name).join(lookup, ["entity_kind", "entity_name", "__key"]).drop("__key")

    fills = matched.filter(F.col("entity_id").isNotNull()).groupBy(F.col("entity_id").alias("id")).agg(
        F.min_by("entity_key", F.when(F.col("entity_key").isNotNull(), F.col("seq"))).alias("fill_key"),
        F.min_by("norm", F.when(F.col("norm_id").isNull() & F.col("key_id").isNull(), F.col("seq"))).alias("fill_norm"),
    )
    key_column = F.coalesce("canonical_key", "fill_key") if backfill_key else F.col("canonical_key")
    stamp = F.lit(as_of).cast("bigint")
    named = F.coalesce("normalized_name", "fill_norm")
    changed = ~key_column.eqNullSafe(F.col("canonical_key")) | ~named.eqNullSafe(F.col("normalized_name"))
    filled = entities.join(fills, "id", "left").withColumns(
        {
            "updated_at": F.when(changed, stamp).otherwise(F.col("updated_at")),
            "canonical_key": key_column, "normalized_name": named,
        }
    )
    fresh = created.select(
        F.col("entity_id").alias("id"), F.col("entity_kind").alias("kind"), "name", F.col("norm").alias("normalized_name"),
        F.col("group_key").alias("canonical_key"), F.lit(0.0).alias("momentum_score"),
        F.lit(None).cast("bigint").alias("momentum_at"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    return resolved, filled.select(entities.columns).unionByName(fresh.select(entities.columns))


def check_incoming(incoming: DataFrame) -> DataFrame:
    """Add the resolved ``layer`` and ``reason`` (null when accepted), checked on the raw text."""
    layer = text.resolve_layer(F.col("layer"))
    reason = (
        F.when(layer.isNull(), "unknown_layer")
        .when(F.char_length("content") > text.CONTENT_CAP, "too_long")
        .when(~F.coalesce("force", F.lit(False)) & text.paste_rule(F.col("content")).isNotNull(), "pasted")
    )
    return incoming.withColumn("reason", reason).withColumn("layer", F.coalesce(layer, F.col("layer")))


def ingest_memories(incoming: DataFrame, store: Store, as_of: int) -> tuple[Store, DataFrame, DataFrame]:
    """Store a batch of notes. Returns the store, the accepted rows and the rejected ones with a reason.

    ``incoming``: ``seq, entity_kind, entity_name, entity_key, layer, content, importance,
    expires_at, force``.
    """
    # Texts are checked once, not by every step that reads them.
    checked = cut_lineage(check_incoming(incoming), "checked")
    rejected = checked.filter(F.col("reason").isNotNull())
    resolved, entities = resolve_entities(checked.filter(F.col("reason").isNull()).drop("reason"), store.entities, as_of)
    numbered = global_positions(resolved, ["seq"], "id", next_id(store.memories))
    importance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("importance", F.lit(0.5))))
    stamp = F.lit(as_of).cast("bigint")
    clean = redacted(F.col("content"))
    accepted = numbered.select(
        "id", "entity_id", "layer", clean.alias("content"), importance.alias("importance"),
        ((importance >= scoring.PIN_IMPORTANCE) | (F.col("layer") == "realize")).alias("protected"),
        F.lit(None).cast("string").alias("source"),
        stamp.alias("created_at"), stamp.alias("last_accessed_at"), F.lit(0).alias("access_count"),
        F.coalesce("expires_at", scoring.default_expiry(F.col("layer"), stamp)).alias("expires_at"),
        F.lit("pending").alias("embedding_status"), text.tokenized(clean).alias("content_tokenized"),
    )
    payload = F.to_json(F.struct("layer", F.col("id").alias("memory_id")))
    events = event_rows(accepted, F.col("entity_id"), F.lit("memory_stored"), payload, as_of)
    updated = store.with_(
        entities=entities,
        memories=store.memories.unionByName(accepted, allowMissingColumns=True),
        events=append_rows(store.events, events),
    )
    return updated, accepted, rejected


def update_memories(store: Store, patches: DataFrame, as_of: int) -> tuple[Store, DataFrame]:
    """Edit memories. ``patches``: one row per ``memory_id`` with ``content, layer, importance`` or nulls."""
    existing = store.memories.select(
        F.col("id").alias("memory_id"), "entity_id", F.col("layer").alias("old_layer"),
        F.col("content").alias("old_content"), F.col("protected").alias("was_protected"),
    )
    joined = patches.join(existing, "memory_id", "left")
    target = text.resolve_layer(F.col("layer"))
    outcome = (
        F.when(F.col("entity_id").isNull(), "not_found")
        .when(F.char_length("content") > text.CONTENT_CAP, "too_long")
        .when(F.col("layer").isNotNull() & target.isNull(), "unknown_layer")
        .when((F.col("old_layer") == "realize") & (target != "realize") & F.col("was_protected"), "protected_layer")
        .when(F.col("content").isNull() & F.col("layer").isNull() & F.col("importance").isNull(), "nothing")
        .otherwise("updated")
    )
    # least and greatest skip nulls, and no importance means no change.
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance")))
    importance = F.when(F.col("importance").isNotNull(), clamped)
    clean = redacted(F.col("content"))
    changed = F.array_compact(
        F.array(
            F.when(F.col("content").isNotNull(), "content"),
            F.when(F.col("layer").isNotNull(), "layer"),
            F.when(F.col("importance").isNotNull(), "importance"),
            F.when(F.col("importance").isNotNull(), "protected"),
        )
    )
    report = joined.select(
        "memory_id", outcome.alias("outcome"), "entity_id", changed.alias("changed"), clean.alias("new_content"),
        target.alias("new_layer"), importance.alias("new_importance"),
        F.coalesce(clean != F.col("old_content"), F.lit(False)).alias("content_changed"),
    )
    report = cut_lineage(report)
    good = report.filter(F.col("outcome") == "updated").withColumnRenamed("memory_id", "id")
    merged = store.memories.join(
        good.select("id", "new_content", "new_layer", "new_importance", "content_changed"), "id", "left"
    )
    reset = F.coalesce("content_changed", F.lit(False))

    def unless_reset(name: str) -> Column:
        return F.when(~reset, F.col(name))

    pinned = (F.col("new_importance") >= scoring.PIN_IMPORTANCE) | F.col("protected")
    memories = merged.withColumns(
        {
            "content": F.coalesce("new_content", "content"),
            "layer": F.coalesce("new_layer", "layer"),
            "importance": F.coalesce("new_importance", "importance"),
            "protected": F.when(F.col("new_importance").isNotNull(), pinned).otherwise(F.col("protected")),
            "embedding": unless_reset("embedding"),
            "embedding_model": unless_reset("embedding_model"),
            "embedding_dim": unless_reset("embedding_dim"),
            "embedding_status": F.when(reset, "pending").otherwise(F.col("embedding_status")),
            "content_tokenized": F.when(reset, text.tokenized(F.col("new_content"))).otherwise(F.col("content_tokenized")),
        }
    ).select(column_names("memories"))
    payload = F.to_json(F.struct(F.col("id").alias("memory_id"), "changed"))
    events = event_rows(good, F.col("entity_id"), F.lit("memory_updated"), payload, as_of)
    updated = store.with_(memories=memories, events=append_rows(store.events, events))
    return updated, report.select("memory_id", "outcome", "changed")


def vector_outcomes(vectors: DataFrame, memories: DataFrame, dim: int) -> DataFrame:
    """``vectors(seq, id, vec, model, content_sha1)`` with an outcome per row."""
    tokenised = F.col("content_tokenized")
    body = F.when(F.char_length(tokenised) > 0, tokenised).otherwise(F.col("content"))
    targets = memories.select("id", F.sha1(body).alias("__sha1"), "archived_at", F.lit(True).alias("__known"))
    joined = vectors.join(targets, "id", "left")
    valid = (F.size("vec") == dim) & is_finite(F.col("vec")) & (F.col("model") != "")
    outcome = (
        F.when(~F.coalesce(valid, F.lit(False)), "bad_request")
        .when(F.col("__known").isNull() | F.col("archived_at").isNotNull(), "not_found")
        .when((F.col("content_sha1") != "") & (F.col("content_sha1") != F.col("__sha1")), "content_changed")
        .otherwise("ok")
    )
    return joined.select(*vectors.columns, outcome.alias("outcome"))


def ingest_vectors(vectors: DataFrame, memories: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Memories with the accepted vectors (the last per id by ``seq``) and the outcome of every row."""
    outcomes = vector_outcomes(vectors, memories, dim)
    last = (
        outcomes.filter(F.col("outcome") == "ok")
        .groupBy("id")
        .agg(F.max_by(F.struct("vec", "model"), "seq").alias("__new"))
    )
    return apply_vectors(memories, last.select("id", "__new.vec", "__new.model"), dim), outcomes


def apply_vectors(memories: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    joined = memories.join(vectors.select("id", "vec", "model"), "id", "left")
    given = F.col("vec").isNotNull()
    return joined.withColumns(
        {
            "embedding": F.when(given, F.col("vec").cast("array<float>")).otherwise(F.col("embedding")),
            "embedding_model": F.when(given, F.col("model")).otherwise(F.col("embedding_model")),
            "embedding_dim": F.when(given, F.lit(dim)).otherwise(F.col("embedding_dim")),
            "embedding_status": F.when(given, "done").otherwise(F.col("embedding_status")),
        }
    ).select(memories.columns)


def keyword_encoder(dim: int = 64, unit: bool = True) -> Encoder:
    """Offline default: token counts in ``dim`` buckets of the token's MD5, scaled to length one (or exact, as whole numbers)."""

    @lru_cache(maxsize=1 << 16)
    def bucket(token: str) -> int:
        return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dim

    def encode(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for body in texts:
            places = [bucket(t) for t in body.split()]
            counts = np.bincount(places, minlength=dim).astype(np.float64) if places else np.zeros(dim)
            norm = np.linalg.norm(counts) if unit else 0
            out.append((counts / norm if norm else counts).tolist())
        return out

    return encode


def encode_texts(rows: DataFrame, encoder_factory: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """(id, body) -> (id, vec). The factory runs once per task, where a real model would be loaded.

    A null result, for one text or for a whole batch, leaves those rows out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for pdf in batches:
            ids, vecs = [], []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                made = encode(part["body"].tolist()) or [None] * len(part)
                for row_id, vec in zip(part["id"], made):
                    if vec is not None:
                        ids.append(row_id)
                        vecs.append(vec)
            if ids:
                yield pd.DataFrame({"id": ids, "vec": vecs})

    ship_package(rows.sparkSession)
    return rows.select("id", "body").mapInPandas(run, "id bigint, vec array<float>")


def embedding_body(with_prefix: str = "") -> Column:
    tokenised = F.col("content_tokenized")
    body = F.when(F.char_length(tokenised) > 0, tokenised).otherwise(F.col("content"))
    return F.concat(F.lit(with_prefix), body) if with_prefix else body


def embed_backlog(
    store: Store, encoder_factory: Callable[[], Encoder], model: str, dim: int, limit: int | None = None, prefix: str = ""
) -> Store:
    """Embed the pending active rows, all or the oldest ``limit``; rows without a vector stay pending."""
    waiting = store.memories.filter((F.col("embedding_status") == "pending") & F.col("archived_at").isNull())
    targets = waiting.select("id", "created_at", embedding_body(prefix).alias("body"))
    if limit is not None:
        targets = targets.orderBy("created_at", "id").limit(limit)
    targets = targets.repartition(int(store.memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    vectors = encode_texts(targets, encoder_factory).withColumn("model", F.lit(model))
    return store.with_(memories=apply_vectors(store.memories, vectors, dim))


def stale_vectors(model: str, dim: int) -> Column:
    same = F.col("embedding_model").eqNullSafe(model) & F.col("embedding_dim").eqNullSafe(dim)
    return (F.col("embedding_status") == "done") & F.col("archived_at").isNull() & ~same


def reset_stale_vectors(memories: DataFrame, model: str, dim: int) -> DataFrame:
    status = F.when(stale_vectors(model, dim), "pending").otherwise(F.col("embedding_status"))
    return memories.withColumn("embedding_status", status)


def tokenize_backfill(memories: DataFrame) -> DataFrame:
    due = F.col("content_tokenized").isNull() & F.col("archived_at").isNull()
    return memories.withColumn(
        "content_tokenized", F.when(due, text.tokenized(F.col("content"))).otherwise(F.col("content_tokenized"))
    )


def tokenize_backlog_count(memories: DataFrame) -> DataFrame:
    due = memories.filter(F.col("content_tokenized").isNull() & F.col("archived_at").isNull())
    return due.agg(F.count("*").alias("to_tokenize"))


def pending_backlog(memories: DataFrame, cursor: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
    """A keyset page of rows waiting for a vector, each with the text to embed."""
    waiting = (F.col("embedding_status") == "pending") & F.col("archived_at").isNull() & (F.col("id") > cursor)
    has_text = F.char_length(F.coalesce("content_tokenized", "content")) > 0
    page = memories.filter(waiting & has_text).select("id", "content", embedding_body().alias("text_for_embedding"))
    return page.orderBy("id").limit(limit)


def pending_remaining(memories: DataFrame) -> DataFrame:
    waiting = (F.col("embedding_status") == "pending") & F.col("archived_at").isNull()
    return memories.filter(waiting).agg(F.count("*").alias("remaining"))



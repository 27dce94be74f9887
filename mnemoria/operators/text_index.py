"""Full-text search by stored postings: a table by term, of which a search reads only the terms it asks for.

Memories are dealt into shards of bounded size by the hash of their id. ``postings`` has a row per shard and term with the ids that
hold it, in folders by the hash of the term; ``rows`` has one row per shard with the lengths, layers and states of its memories.
Postings never change with a memory's state, so hiding or layering memories only rewrites the narrow ``rows``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemoria.operators.search import B, CHUNK, K1, merge_ranked, query_terms, weighted_queries
from mnemoria.runtime import ship_package, stored
from mnemoria.scale import in_blocks

#: Memories per shard, on average; folders by term; shards whose postings are gathered by one task and folder.
SHARD_ROWS = 16_384
FOLDERS = 64
SPAN = 64

#: The layer of a memory that is no more; a blank is in no layer's name.
GONE = " gone"

POSTINGS = "shard int, term string, ids array<bigint>, counts array<int>, n bigint, part string, folder int"
MEMBERS = "ids array<bigint>, sizes array<int>, layers array<string>, archived array<boolean>, superseded array<boolean>"
ROWS = f"part string, shard int, members bigint, tokens bigint, {MEMBERS}"
HITS = "query_id string, id bigint, bm25 double"


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    rows: DataFrame


def _folder(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _as_members(rows: DataFrame) -> DataFrame:
    """One row per shard from (part, shard, id, size, layer, archived_at, superseded_by_id), its arrays in the order of ids."""
    member = F.struct(
        "id", F.col("size").cast("int").alias("size"), "layer", F.col("archived_at").isNotNull().alias("archived"),
        F.col("superseded_by_id").isNotNull().alias("superseded"),
    )
    held = rows.groupBy("part", "shard").agg(
        F.count("*").alias("members"), F.sum("size").cast("bigint").alias("tokens"), F.array_sort(F.collect_list(member)).alias("m")
    )
    return held.select(
        "part", "shard", "members", "tokens", F.col("m.id").alias("ids"), F.col("m.size").alias("sizes"), F.col("m.layer").alias("layers"),
        F.col("m.archived").alias("archived"), F.col("m.superseded").alias("superseded"),
    )


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, id, term, times) of rows (shard, id, content_tokenized), a piece of a batch at a time and without a Python string a word."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            words = pc.split_pattern(piece.column("content_tokenized"), " ")
            row = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
            coded = words.flatten().dictionary_encode()
            code, n = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(code, len(coded.dictionary))
            own = pa.array(row)
            columns = [piece.column("shard").take(own), piece.column("id").take(own), coded.dictionary.take(pa.array(term))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int32))], names=["shard", "id", "term", "times"])


def write_index(memories: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> TextIndex:
    """Index the tokenised rows of ``memories`` (ids are unique) below ``path``; on an index there, add them as a part of their own.

    Rows without ``content_tokenized`` are skipped, as the search skips them. Terms are counted where a row lies; what is shuffled is
    one row per memory and distinct term, once. A part counts when its ``rows`` are there, which are written last, so that what a
    failed run left of its postings is never read.
    """
    spark = memories.sparkSession
    ship_package(spark)
    corpus = memories.filter(F.col("content_tokenized").isNotNull())
    part = F.lit(uuid.uuid4().hex).alias("part")
    shards = max(1, -(-corpus.count() // shard_rows))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    terms = corpus.select(shard.alias("shard"), "id", "content_tokenized").mapInArrow(
        counted_terms, "shard int, id bigint, term string, times int"
    ).filter(F.col("term") != "")
    # One exchange serves the grouping and the files: a folder's postings of a span of shards make one file.
    postings = (
        terms.withColumns({"folder": _folder(), "span": F.floor(F.col("shard") / SPAN)}).repartition("folder", "span")
        .groupBy("folder", "span", "shard", "term").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("p"))
        .select("shard", "term", F.col("p.id").alias("ids"), F.col("p.times").alias("counts"), F.size("p").cast("bigint").alias("n"), part, "folder")
        .sortWithinPartitions("folder", "term", "shard")
    )
    postings.write.mode("append").partitionBy("part", "folder").parquet(f"{path}/postings")
    size = F.when(F.col("content_tokenized") == "", 0).otherwise(F.size(F.split("content_tokenized", " ")))
    state = corpus.select(part, shard.alias("shard"), "id", size.alias("size"), "layer", "archived_at", "superseded_by_id")
    _as_members(state).write.mode("append").parquet(f"{path}/rows")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    # As many values as times the index was added to.
    parts = [r[0] for r in rows.select("part").distinct().collect()]
    return TextIndex(spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("part").isin(parts)), rows)


def with_states(index: TextIndex, memories: DataFrame) -> TextIndex:
    """The index with the layers and states that ``memories`` have now; those that are gone are hidden, contents must be the same.

    Reads four narrow columns of ``memories`` and writes the new ``rows``; the postings stay where they are.
    """
    placed = index.rows.select("part", "shard", F.explode(F.arrays_zip("ids", "sizes")).alias("m")).select(
        "part", "shard", F.col("m.ids").alias("id"), F.col("m.sizes").alias("size")
    )
    now = memories.select("id", "layer", "archived_at", "superseded_by_id", F.lit(True).alias("there"))
    joined = placed.join(now, "id", "left")
    gone = F.col("there").isNull()
    state = joined.withColumn("layer", F.when(gone, F.lit(GONE)).otherwise(F.col("layer")))
    return TextIndex(index.postings, stored(_as_members(state.drop("there")), "index-rows"))


def indexed_search(
    queries: DataFrame, index: TextIndex, limit: int = 600, min_chars: int = 1, right_rows: int = 4096,
    include_archived: bool = False, include_superseded: bool = False,
) -> DataFrame:
    """``bm25_search`` from an index: (query_id, id, bm25, fts_rank), the same rows.

    Only folders with a term of the queries are read, and of them only those terms leave the scan. They and the shards' rows meet by
    shard; a task scores one shard, of bounded size, and hands on the best ``limit`` rows of each query.
    """
    spark = queries.sparkSession
    ship_package(spark)
    asked = stored(query_terms(queries, min_chars).select("term").distinct(), "asked-terms")
    # At most as many values as there are folders.
    folders = [r[0] for r in asked.select(_folder().alias("folder")).distinct().collect()]
    held = index.postings.where(F.col("folder").isin(folders)).join(asked, "term", "left_semi")
    frequency = held.groupBy("term").agg(F.sum("n").alias("df"))
    totals = index.rows.agg(F.sum("members").alias("rows"), F.sum("tokens").alias("tokens")).first()
    rows, mean = (totals["rows"], max(totals["tokens"], 1) / totals["rows"]) if totals["rows"] else (0, 1.0)
    by_query = weighted_queries(queries, frequency, rows, min_chars)
    postings = held.select("part", "shard", "term", "ids", "counts")

    def against(shared) -> DataFrame:
        def scored(postings: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            return _score_shard(postings, members, shared.value, mean, limit, include_archived, include_superseded)

        return postings.groupBy("part", "shard").cogroup(index.rows.groupBy("part", "shard")).applyInPandas(scored, HITS)

    return merge_ranked(in_blocks(by_query, "query_id", against, right_rows), limit, "fts_rank", F.desc("bm25"))


def _score_shard(
    postings: pd.DataFrame, members: pd.DataFrame, asked: pd.DataFrame, mean: float, limit: int, archived: bool, superseded: bool
) -> pd.DataFrame:
    """The best ``limit`` rows of a shard for each query."""
    none = pd.DataFrame({"query_id": pd.Series(dtype=object), "id": pd.Series(dtype=np.int64), "bm25": pd.Series(dtype=float)})
    if postings.empty or members.empty or asked.empty:
        return none
    own = members.iloc[0]
    ids, sizes = np.asarray(own["ids"], dtype=np.int64), np.asarray(own["sizes"], dtype=float)
    layers = np.asarray(own["layers"], dtype=object)
    shown = _shown(np.asarray(own["archived"], bool), np.asarray(own["superseded"], bool), archived, superseded) & (layers != GONE)
    longer = K1 * (1 - B + B * sizes / mean)
    found = {}
    for term, holders, times in zip(postings["term"], postings["ids"], postings["counts"]):
        place = np.searchsorted(ids, np.asarray(holders, dtype=np.int64))
        times = np.asarray(times, dtype=float)
        found[term] = place, times * (K1 + 1) / (times + longer[place])
    of_layer: dict[str, np.ndarray] = {}
    out = []
    for name, layer, terms, weights in zip(asked["query_id"], asked["layer"], asked["terms"], asked["weights"]):
        score = np.zeros(len(ids))
        for term, weight in zip(terms, weights):
            if term in found:
                place, share = found[term]
                score[place] += weight * share
        score = np.round(score, 9)
        allowed = shown
        if isinstance(layer, str):
            if layer not in of_layer:
                of_layer[layer] = layers == layer
            allowed = shown & of_layer[layer]
        hit = np.flatnonzero((score > 0) & allowed)
        if len(hit) > limit:
            hit = hit[np.lexsort((ids[hit], -score[hit]))[:limit]]
        if len(hit):
            out.append(pd.DataFrame({"query_id": name, "id": ids[hit], "bm25": score[hit]}))
    return pd.concat(out, ignore_index=True) if out else none


def _shown(archived: np.ndarray, superseded: np.ndarray, with_archived: bool, with_superseded: bool) -> np.ndarray:
    """The rule of ``filters.visible`` on arrays."""
    if with_archived and with_superseded:
        return np.ones(len(archived), bool)
    if with_archived:
        return ~superseded
    if with_superseded:
        return ~archived | superseded
    return ~superseded & ~archived

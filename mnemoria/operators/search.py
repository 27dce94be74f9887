"""Full-text, substring and vector search for a table of queries, and their union.

Each path scores memories where they lie: the corpus is never shuffled, a task keeps only its
own best rows per query, and only those meet in the final per-query ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from mnemoria.functions import text
from mnemoria.functions.vectors import unit_rows
from mnemoria.operators.filters import visible_memories
from mnemoria.operators.joins import memory_entity_view
from mnemoria.runtime import cut_lineage
from mnemoria.scale import blocked_product

# BM25 saturation, length weight and the floor of a term's weight.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
# Rows and queries scored at once.
CHUNK = 1024
QUERY_BLOCK = 256
MIN_COSINE = 0.55
VECTOR_TOP_K = 200


def by_layer(queries: DataFrame) -> DataFrame:
    """Queries with their ``layer`` resolved: an alias names its layer, any other word filters nothing."""
    return queries.withColumn("layer", text.resolve_layer(F.col("layer")))


class BestPerQuery:
    """Running best ``k`` rows per query: keys descending in turn, then id ascending."""

    def __init__(self, k: int, queries: int, keys: int):
        self.k, self.keys = k, keys
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.room = 2 * k * max(queries, 1) + 200_000

    def add(self, query: np.ndarray, ids: np.ndarray, *keys: np.ndarray) -> None:
        keep = keys[0] >= self.floor[query]
        if keep.any():
            self.parts.append((query[keep], ids[keep], *[k[keep] for k in keys]))
            self.held += int(keep.sum())
            if self.held > self.room:
                self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        query, ids, *keys = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort((ids, *[-k for k in reversed(keys)], query))
        query, ids, keys = query[order], ids[order], [k[order] for k in keys]
        first = np.r_[True, query[1:] != query[:-1]]
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[query[full]] = keys[0][full]
        self.parts = [(query[keep], ids[keep], *[k[keep] for k in keys])]
        self.held = int(keep.sum())

    def result(self) -> tuple[np.ndarray, ...] | None:
        self.shrink()
        return self.parts[0] if self.parts else None


def _layer_allows(query_layers: pd.Series, row_layers: pd.Series) -> np.ndarray | None:
    """Boolean (rows x queries) or None when no query names a layer."""
    wanted = [(i, w) for i, w in enumerate(query_layers) if isinstance(w, str)]
    if not wanted:
        return None
    rows = row_layers.to_numpy(dtype=object)
    allowed = np.ones((len(rows), len(query_layers)), dtype=bool)
    of_layer = {w: rows == w for w in {w for _, w in wanted}}
    for i, w in wanted:
        allowed[:, i] = of_layer[w]
    return allowed


def merge_ranked(hits: DataFrame, limit: int, rank: str, *order, ways: int | None = None) -> DataFrame:
    """The best ``limit`` rows per query from the best rows of every task.

    row_number <= n lets Spark limit each group before a shuffle (WindowGroupLimit). On a large
    cluster a query still has ``limit`` rows from each of very many tasks; these are first merged
    in several ways by the hash of the id, so that no single task sees them all.
    """
    if ways is None:
        ways = min(64, hits.sparkSession.sparkContext.defaultParallelism // 16)
    if ways > 1:
        part = W.partitionBy("query_id", "__way").orderBy(*order, "id")
        split = hits.withColumn("__way", F.pmod(F.xxhash64("id"), F.lit(ways)))
        hits = split.withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= limit).drop("__rn", "__way")
    w = W.partitionBy("query_id").orderBy(*order, "id")
    return hits.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def query_terms(queries: DataFrame, min_chars: int = 1) -> DataFrame:
    """(query_id, layer, term, times): the tokens of each query that names no entity."""
    free = by_layer(queries).filter(F.col("entity_name").isNull())
    exploded = free.select("query_id", "layer", F.explode(text.tokens(F.col("text"))).alias("term"))
    return exploded.filter(F.char_length("term") >= min_chars).groupBy("query_id", "layer", "term").agg(
        F.count("*").alias("times")
    )


def weighted_queries(queries: DataFrame, frequency: DataFrame, rows: int, min_chars: int) -> DataFrame:
    """(query_id, layer, terms, weights) of queries with a term in ``frequency`` (term, df), the terms of ``rows`` rows.

    One row per query; its arrays are as long as the query has distinct words.
    """
    weight = F.log((F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries, min_chars).join(frequency, "term").withColumn(
        "weight", F.col("times") * F.when(weight > 0, weight).otherwise(IDF_FLOOR)
    )
    return (
        weighted.groupBy("query_id", "layer")
        .agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))
        .select("query_id", "layer", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"))
    )


def bm25_search(
    queries: DataFrame, memories: DataFrame, limit: int = 600, min_chars: int = 1, right_rows: int = 4096, **flags: bool
) -> DataFrame:
    """(query_id, id, bm25, fts_rank). Any query token may match; higher scores are better.

    Document frequency and average length come from every tokenised row, hidden ones included;
    visibility and layer apply to the hits only. Rows without ``content_tokenized`` are skipped.
    """
    corpus = memories.filter(F.col("content_tokenized").isNotNull())
    words = F.split("content_tokenized", " ")
    size = F.when(F.col("content_tokenized") == "", 0).otherwise(F.size(words))
    # One pass counts the rows per term and, under names no term can have (a blank and the
    # length), the rows per length. Counted before the shuffle: a term is one row per task.
    marked = F.array_append(F.array_distinct(words), F.concat(F.lit(" "), size.cast("string")))
    counted = cut_lineage(corpus.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    is_length = F.col("term").startswith(" ")
    totals = counted.filter(is_length).agg(
        F.sum("df").alias("rows"), F.sum(F.col("df") * F.trim("term").cast("bigint")).alias("tokens")
    ).first()
    rows, mean = (totals["rows"], max(totals["tokens"], 1) / totals["rows"]) if totals["rows"] else (0, 1.0)
    frequency = counted.filter(~is_length)
    by_query = weighted_queries(queries, frequency, rows, min_chars)

    def kernel(batches: Iterator[pd.DataFrame], q: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if q.empty:
            return
        vocabulary = pa.array(sorted({term for terms in q["terms"] for term in terms}))
        # A weight per term and query, in blocks of queries that share few enough terms to be held as a matrix.
        blocks = []
        for first in range(0, len(q), QUERY_BLOCK):
            part = q.iloc[first : first + QUERY_BLOCK]
            place = pc.index_in(pa.array(np.concatenate(part["terms"].tolist())), value_set=vocabulary).to_numpy()
            used, own = np.unique(place, return_inverse=True)
            weights = np.zeros((len(used), len(part)))
            weights[own, np.repeat(np.arange(len(part)), part["terms"].map(len))] = np.concatenate(part["weights"].tolist())
            local = np.full(len(vocabulary), -1)
            local[used] = np.arange(len(used))
            blocks.append((first, local, weights))
        names = q["query_id"].to_numpy(dtype=object)
        best = BestPerQuery(limit, len(q), 1)
        for batch in batches:
            allowed = _layer_allows(q["layer"], batch["layer"])
            ids = batch["id"].to_numpy(dtype=np.int64)
            for at in range(0, len(batch), CHUNK):
                words = pc.split_pattern(pa.array(batch["content_tokenized"].iloc[at : at + CHUNK], pa.string()), " ")
                offsets = np.asarray(words.offsets)
                place = pc.index_in(words.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(len(words)), np.diff(offsets))
                # (row, term) with its count.
                code, tf = np.unique(row[place >= 0] * len(vocabulary) + place[place >= 0], return_counts=True)
                row, place = np.divmod(code, len(vocabulary))
                size = np.diff(offsets)[row]
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
                for first, local, weights in blocks:
                    own = local[place]
                    held = np.zeros((len(words), len(weights)))
                    held[row[own >= 0], own[own >= 0]] = share[own >= 0]
                    score = np.round(held @ weights, 9)
                    hit = score > 0
                    if allowed is not None:
                        hit &= allowed[at : at + CHUNK, first : first + weights.shape[1]]
                    r, c = np.nonzero(hit)
                    best.add(first + c, ids[at + r], score[r, c])
        out = best.result()
        if out is not None:
            yield pd.DataFrame({"query_id": names[out[0]], "id": out[1], "bm25": out[2]})

    shown = visible_memories(corpus, **flags).select("id", "layer", "content_tokenized")
    hits = blocked_product(
        shown, by_query, kernel, "query_id string, id bigint, bm25 double", "query_id", right_rows=right_rows
    )
    return merge_ranked(hits, limit, "fts_rank", F.desc("bm25"))


def substring_search(
    queries: DataFrame, memories: DataFrame, entities: DataFrame, limit: int | None = 600, right_rows: int = 4096,
    **flags: bool,
) -> DataFrame:
    """(query_id, id, importance, last_accessed_at, like_rank, in_entity), or all hits unranked.

    A query that names an entity looks for that name in entity names only and ignores its text;
    any other query looks for its text, literally and case-insensitively, in names and contents.
    """
    needles = by_layer(queries).select(
        "query_id",
        "layer",
        F.lower(F.coalesce("entity_name", "text")).alias("needle"),
        F.col("entity_name").isNotNull().alias("entity_only"),
    ).filter(F.col("needle").isNotNull())
    shown = visible_memories(memories, **flags).select(
        "id", "entity_id", "layer", "importance", "last_accessed_at", F.lower("content").alias("content")
    )
    haystack = memory_entity_view(shown, entities).select(
        "id", "layer", "importance", "last_accessed_at", "content", F.lower("entity_name").alias("entity_name")
    )

    def kernel(batches: Iterator[pd.DataFrame], q: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if q.empty:
            return
        finder = _Finder(q["needle"].tolist())
        entity_only = q["entity_only"].to_numpy(dtype=bool)
        names = q["query_id"].to_numpy(dtype=object)
        best = BestPerQuery(limit or 0, len(q), 3)
        for batch in batches:
            rows = []
            allowed = _layer_allows(q["layer"], batch["layer"])
            cache: dict[str, np.ndarray] = {}
            columns = zip(
                batch["id"], batch["importance"], batch["last_accessed_at"], batch["content"], batch["entity_name"]
            )
            for i, (row_id, importance, accessed, content, entity) in enumerate(columns):
                if entity not in cache:
                    cache[entity] = finder.mask(entity)
                by_name = cache[entity]
                hit = by_name | (finder.mask(content) & ~entity_only)
                if allowed is not None:
                    hit = hit & allowed[i]
                found = np.flatnonzero(hit)
                if limit is None:
                    rows += [(names[c], row_id, importance, accessed, by_name[c]) for c in found]
                elif len(found):
                    ones = np.ones(len(found))
                    best.add(
                        found,
                        np.full(len(found), row_id, dtype=np.int64),
                        ones * importance,
                        ones * accessed,
                        by_name[found].astype(float),
                    )
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "id", "importance", "last_accessed_at", "in_entity"])
        out = best.result()
        if out is not None:
            yield pd.DataFrame(
                {
                    "query_id": names[out[0]],
                    "id": out[1],
                    "importance": out[2],
                    "last_accessed_at": out[3].astype(np.int64),
                    "in_entity": out[4] > 0,
                }
            )

    schema = "query_id string, id bigint, importance double, last_accessed_at bigint, in_entity boolean"
    hits = blocked_product(haystack, needles, kernel, schema, "query_id", right_rows=right_rows)
    if limit is None:
        return hits
    return merge_ranked(hits, limit, "like_rank", F.desc("importance"), F.desc("last_accessed_at"))


class _Finder:
    """Which of many needles occur in a text, by one pass of an automaton."""

    def __init__(self, needles: list[str]):
        self.n = len(needles)
        self.always = np.array([x == "" for x in needles], dtype=bool)
        self.where: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            if needle:
                self.where.setdefault(needle, []).append(i)
        self.automaton = None
        if self.where:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for needle, places in self.where.items():
                self.automaton.add_word(needle, places)
            self.automaton.make_automaton()

    def mask(self, haystack: str) -> np.ndarray:
        out = self.always.copy()
        if self.automaton is not None:
            for _, places in self.automaton.iter(haystack):
                out[places] = True
        return out


def vector_search(
    queries: DataFrame, memories: DataFrame, model: str, dim: int, min_cos: float = MIN_COSINE,
    top_k: int = VECTOR_TOP_K, right_rows: int = 4096, **flags: bool,
) -> DataFrame:
    """(query_id, id, cos, vec_rank) over rows embedded by ``model`` in ``dim`` dimensions."""
    known = by_layer(queries).filter(F.size("vec") == dim).select("query_id", "layer", "vec")
    # A filter on plain columns, so it reaches the scan; the size test drops broken vectors.
    done = (F.col("embedding_status") == "done") & (F.col("embedding_model") == model) & (F.col("embedding_dim") == dim)
    rows = visible_memories(memories, **flags).filter(done & (F.size("embedding") == dim))

    def kernel(batches: Iterator[pd.DataFrame], q: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if q.empty:
            return
        asked = unit_rows(q["vec"]).T
        names = q["query_id"].to_numpy(dtype=object)
        best = BestPerQuery(top_k, len(q), 1)
        for batch in batches:
            if batch.empty:
                continue
            allowed = _layer_allows(q["layer"], batch["layer"])
            ids = batch["id"].to_numpy(dtype=np.int64)
            units = unit_rows(batch["embedding"])
            for at in range(0, len(ids), 1024):
                cos = np.round(units[at : at + 1024] @ asked, 6)
                hit = cos >= np.maximum(min_cos, best.floor)
                if allowed is not None:
                    hit &= allowed[at : at + 1024]
                r, c = np.nonzero(hit)
                best.add(c, ids[at + r], cos[r, c])
        out = best.result()
        if out is not None:
            yield pd.DataFrame({"query_id": names[out[0]], "id": out[1], "cos": out[2]})

    hits = blocked_product(
        rows.select("id", "layer", "embedding"), known, kernel, "query_id string, id bigint, cos double",
        "query_id", right_rows=right_rows,
    )
    return merge_ranked(hits, top_k, "vec_rank", F.desc("cos"))


def minmax_vector_scores(hits: DataFrame) -> DataFrame:
    from mnemoria.functions.scoring import min_max

    w = W.partitionBy("query_id")
    return hits.withColumn("vec_norm", min_max(F.col("cos"), F.min("cos").over(w), F.max("cos").over(w)))


def merge_candidates(fts: DataFrame | None, like: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Union of the paths keyed by (query_id, id), with the ranks, the cosine and the provenance."""
    parts = [like.select("query_id", "id", "like_rank", "in_entity")]
    if fts is not None:
        parts.append(fts.select("query_id", "id", "fts_rank", "bm25"))
    if vectors is not None:
        parts.append(vectors.select("query_id", "id", "vec_rank", "cos"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    for name, kind in [("fts_rank", "int"), ("bm25", "double"), ("vec_rank", "int"), ("cos", "double")]:
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast(kind))
    keyed = merged.groupBy("query_id", "id").agg(
        *[F.max(c).alias(c) for c in ["fts_rank", "bm25", "like_rank", "vec_rank", "cos", "in_entity"]]
    )
    has_text, has_like = F.col("fts_rank").isNotNull(), F.col("like_rank").isNotNull()
    via = (
        F.when(F.col("vec_rank").isNotNull(), F.when(has_text, "vector+fts").when(has_like, "vector+like").otherwise("vector"))
        .when(has_text & has_like, "fts+like")
        .when(has_text, "fts")
        .otherwise("like")
    )
    return keyed.withColumn("via", via)


def hybrid_candidates(
    queries: DataFrame, memories: DataFrame, entities: DataFrame, model: str | None = None, dim: int = 0,
    min_cos: float = MIN_COSINE, fetch: int = 600, min_chars: int = 1, vector_top: int = VECTOR_TOP_K,
    fts: DataFrame | None = None, **flags: bool,
) -> DataFrame:
    """The three searches merged; ``fts`` are hits of the full-text search if they are there, as from an index."""
    if fts is None:
        fts = bm25_search(queries, memories, fetch, min_chars, **flags)
    like = substring_search(queries, memories, entities, fetch, **flags)
    vectors = None
    if model:
        asking = queries.filter(F.coalesce("text", F.lit("")) != "")
        vectors = vector_search(asking, memories, model, dim, min_cos, min(vector_top, fetch), **flags)
    return merge_candidates(fts, like, vectors)

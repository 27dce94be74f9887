"""Phrases whose words occur together more than their parts suggest, mined by a multikey quicksort of suffixes.

Tasks code the words of their documents as sequences. Words below the least count end a suffix, as no phrase with them can reach
it. Suffixes, cut to the longest phrase and counted once per task where they are equal, are routed by their two leading words, so
that all occurrences of a phrase come to one bucket. There a three-way quicksort on one word after another parts them into
smaller, equal and larger: the size of an equal part is a phrase's count, and parts below the least count are abandoned. A bucket
far above the average, as a pair of words that is everywhere makes it, is split by whole suffixes, and its counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.llm.common import documents, ship_package, stored, text_or_empty
from mnemoria.llm.terms import SHARD_WORDS, Vocabulary, global_codes, one_list, packed, shard_number, unpacked
from mnemoria.scale import global_positions

#: Words of the longest phrase.
DEPTH = 4
#: Parts of at most as many suffixes are sorted at once, as a quicksort leaves its small parts to a simpler sort.
SMALL = 4096
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    least_count: int = 30
    #: Phrases per language in the report.
    top: int = 2000
    #: A phrase is covered by a longer one that has this share of its occurrences, in hundredths.
    cover: int = 80
    #: Score of a phrase whose parts occur nowhere else.
    scale: int = 1_000_000
    #: Suffixes of a bucket, on average.
    bucket_rows: int = 1_000_000
    #: A bucket is split above this many times the average.
    most_over: int = 2


def sequences(docs: DataFrame, text: str, lang: str, shard_words: int) -> DataFrame:
    """(shard, lang, n_codes, codes, words, times): texts in lower case (A-Z) as ``packed`` codes of ``words`` from 1 on; 0 ends a piece."""
    ship_package(docs.sparkSession)
    narrow = docs.select(
        text_or_empty(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, n = TaskContext.get().partitionId(), 0, {}, 0

        def shards() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name, (words, parts) in held.items():
                codes = np.concatenate([np.zeros(0, np.int32), *parts])
                times = np.bincount(codes, minlength=len(words) + 1)[1:]
                own = [pa.array([shard_number(task, made)], pa.int64()), pa.array([name], pa.string()), pa.array([len(codes)], pa.int64())]
                lists = [one_list(words.strings()), one_list(pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([packed(codes)], pa.binary()), *lists], ["shard", "lang", "n_codes", "codes", "words", "times"]
                )
                made += 1
            held.clear()

        for batch in batches:
            for raw, name in zip(batch.column(0), batch.column(1).to_pylist()):
                words, parts = held.setdefault(name, (Vocabulary(1), []))
                code, flat = words.__getitem__, []
                for piece in raw.as_py().lower().translate(_TO_LINES).split(b"\n"):
                    found = piece.split()
                    if found:
                        flat.extend(map(code, found))
                        flat.append(0)
                if flat:
                    parts.append(np.array(flat, dtype=np.int32))
                    n += len(flat)
                if n >= shard_words:
                    yield from shards()
                    n = 0
        yield from shards()

    return narrow.mapInArrow(encode, "shard bigint, lang string, n_codes bigint, codes binary, words array<string>, times array<bigint>")


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different suffixes of two words or more, cut to ``DEPTH`` and padded with 0, in order, and how often each occurs."""
    padded = np.concatenate([ids, np.zeros(DEPTH, ids.dtype)])
    begin = np.flatnonzero((ids > 0) & (padded[1 : len(ids) + 1] > 0))
    out = padded[begin[:, None] + np.arange(DEPTH)]
    for depth in range(2, DEPTH):
        out[out[:, depth - 1] == 0, depth] = 0
    out = out[np.lexsort(out.T[::-1])]
    first = np.flatnonzero(np.r_[True, (out[1:] != out[:-1]).any(axis=1)][: len(out)])
    return out[first], np.diff(np.r_[first, len(out)])


def mixed(words: np.ndarray) -> np.ndarray:
    """A hash per row of word numbers."""
    h = np.zeros(len(words), dtype=np.uint64)
    for column in words.T:
        h = (h ^ column.astype(np.uint64)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h * _U(0xBF58476D1CE4E5B9) >> _U(17)


def frequent_prefixes(words: np.ndarray, times: np.ndarray, least: int, partial: bool, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(prefixes padded with 0, counts) of the prefixes of two words or more that occur ``least`` times, by multikey quicksort.

    ``words`` (n, DEPTH) are suffixes that end at their first 0. The stack holds parts whose suffixes share their first words.
    With ``partial``, other buckets hold suffixes with the same beginning: only whole suffixes are told by their count then, all
    shorter prefixes are given.
    """
    found, counts = [np.zeros((0, DEPTH), words.dtype)], [np.zeros(0, np.int64)]
    stack = [(np.arange(len(words)), 0)]
    while stack:
        at, depth = stack.pop()
        if not len(at) or depth == DEPTH or (times[at].sum() < least and (not partial or depth == DEPTH - 1)):
            continue
        if len(at) <= small:
            at = at[np.lexsort(words[at, depth:].T[::-1])]
            rows = words[at]
            changed = np.zeros(len(at), dtype=bool)
            changed[0] = True
            for length in range(depth + 1, DEPTH + 1):
                changed[1:] |= rows[1:, length - 1] != rows[:-1, length - 1]
                first = np.flatnonzero(changed)
                total = np.add.reduceat(times[at], first)
                enough = partial and length < DEPTH or total >= least
                keep = (rows[first, length - 1] > 0) & enough & (length > 1)
                prefix = rows[first[keep]]
                prefix[:, length:] = 0
                found.append(prefix), counts.append(total[keep])
            continue
        column = words[at, depth]
        pivot = np.median(column[[0, len(at) // 2, -1]]).astype(column.dtype)
        same = at[column == pivot]
        stack += [(at[column < pivot], depth), (at[column > pivot], depth)]
        if not len(same) or pivot == 0:
            continue
        total = times[same].sum()
        if depth and (total >= least or partial and depth + 1 < DEPTH):
            prefix = words[same[:1]].copy()
            prefix[:, depth + 1 :] = 0
            found.append(prefix), counts.append(np.array([total]))
        stack.append((same, depth + 1))
    return np.concatenate(found), np.concatenate(counts)


_BLOB = "bucket bigint, split int, partial boolean, n bigint, suffixes binary"


def _blobs(rows: list[tuple[int, int, bool, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (bucket, split, partial, words, times): suffixes column by column, as sorted columns compress well."""
    buckets, splits, partial, words, times = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(buckets, pa.int64()), pa.array(splits, pa.int32()), pa.array(partial, pa.bool_()), pa.array(map(len, times), pa.int64()),
            pa.array([packed(w.T.astype(np.int32), t.astype(np.int64)) for w, t in zip(words, times)], pa.binary()),
        ],
        ["bucket", "split", "partial", "n", "suffixes"],
    )


def _arrays(batch: pa.RecordBatch | pa.Table, row: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n")[row].as_py()
    data = unpacked(batch.column("suffixes")[row], n * (4 * DEPTH + 8))
    words = np.frombuffer(data, np.int32, n * DEPTH)
    return words.reshape(DEPTH, n).T, np.frombuffer(data, np.int64, n, 4 * DEPTH * n)


def routed(shards: DataFrame, codes: DataFrame, buckets: int) -> DataFrame:
    """Suffixes of the shards as rows of ``_BLOB``, one per shard and bucket of leading pairs."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                places, known = (batch.column(c)[i].values.to_numpy() for c in ("locals", "global"))
                n = batch.column("n_codes")[i].as_py()
                local = np.frombuffer(unpacked(batch.column("codes")[i], 4 * n), np.int32, n)
                of = np.zeros(int(local.max(initial=0)) + 1, dtype=np.int32)
                of[places + 1] = known
                words, times = windows(of[local])
                bucket = (mixed(words[:, :2]) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                rows = [(int(bucket[part[0]]), 0, False, words[part], times[part]) for part in np.split(order, cuts) if len(part)]
                if rows:
                    yield _blobs(rows)

    joined = shards.select("shard", "n_codes", "codes").join(codes.withColumnRenamed("codes", "global"), "shard")
    return joined.select("n_codes", "codes", "locals", "global").mapInArrow(route, _BLOB)


def split_wide(blobs: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """``blobs`` with those of wide buckets cut by whole suffixes; ``sizes`` has (bucket, splits) of the wide ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, times = _arrays(batch, i)
                splits = batch.column("splits")[i].as_py()
                where = (mixed(words) % _U(splits)).astype(np.int64)
                bucket = batch.column("bucket")[i].as_py()
                yield _blobs([(bucket, x, True, words[where == x], times[where == x]) for x in np.unique(where).tolist()])

    wide = blobs.join(sizes, "bucket").select("bucket", "splits", "n", "suffixes").mapInArrow(cut, _BLOB)
    return blobs.join(sizes, "bucket", "left_anti").select(*[c.split()[0] for c in _BLOB.split(", ")]).unionByName(wide)


def phrase_counts(shards: DataFrame, codes: DataFrame, n_words: int, settings: Settings) -> DataFrame:
    """(phrase, a): arrays of word numbers, of two to ``DEPTH`` words, with all their occurrences, from the least count on."""
    spark = shards.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // settings.bucket_rows))
    blobs = stored(routed(shards, codes, buckets), "suffixes")
    rows = blobs.groupBy("bucket").agg(F.sum("n").alias("rows"))
    rows = stored(rows, "bucket-rows")
    total = rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    usual = max(1, total // buckets)
    wide = rows.where(F.col("rows") > settings.most_over * usual).select(
        "bucket", F.ceil(F.col("rows") / usual).cast("int").alias("splits")
    )
    least = settings.least_count

    def mine(table: pa.Table) -> pa.Table:
        parts = [_arrays(table, i) for i in range(table.num_rows)]
        words, times = np.concatenate([w for w, _ in parts]), np.concatenate([t for _, t in parts])
        prefixes, counts = frequent_prefixes(words, times, least, table.column("partial")[0].as_py())
        return pa.table({**{f"w{i}": pa.array(prefixes[:, i], pa.int32()) for i in range(DEPTH)}, "a": pa.array(counts, pa.int64())})

    ship_package(spark)
    keys = [f"w{i}" for i in range(DEPTH)]
    mined = split_wide(blobs, wide, settings).groupBy("bucket", "split").applyInArrow(
        mine, ", ".join(f"{k} int" for k in keys) + ", a bigint"
    )
    summed = mined.groupBy(*keys).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return summed.select(F.filter(F.array(*keys), lambda x: x > 0).alias("phrase"), "a")


def worst_cuts(phrases: DataFrame, counts: DataFrame, settings: Settings) -> DataFrame:
    """(phrase, a, score, l, r): each phrase at the cut with the lowest score, of equal ones the first.

    Products are decimals of 38 digits, so that counts up to 10^18 stay exact.
    """
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")).select(
        "*", F.slice("phrase", F.lit(1), F.col("k")).alias("head"), F.expr("slice(phrase, k + 1, size(phrase) - k)").alias("tail")
    )
    heads = counts.select(F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = counts.select(F.col("phrase").alias("tail"), F.col("a").alias("r"))
    product = f"CAST({2 * settings.scale} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0))"
    score = F.expr(f"CAST(({product}) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    scored = cuts.join(heads, "head").join(tails, "tail").select("phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    least = scored.groupBy("phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    return least.select("phrase", "a", "cut.score", "cut.l", "cut.r")


def inner_phrases(phrase: Column | str) -> Column:
    """The shorter phrases of two words or more that lie in a phrase."""
    return F.expr(
        "flatten(transform(sequence(2, size(phrase) - 1), n -> transform(sequence(1, size(phrase) - n + 1), i -> slice(phrase, i, n))))"
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings(), shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count (both descending) and text.

    A null language counts as ``und``, a null text as empty. Repeated rows count as often as they are there. Ties of all three do not
    occur, as a phrase is one row. A language without a frequent phrase, and so an empty table, gives no row.
    """
    shards = stored(sequences(docs, text, lang, shard_words), "word-sequences")
    words = shards.select("lang", F.inline(F.arrays_zip("words", "times"))).select("lang", F.col("words").alias("word"), "times")
    counted = stored(words.groupBy("lang", "word").agg(F.sum("times").alias("a")), "word-counts")
    totals = stored(counted.groupBy("lang").agg(F.sum("a").alias("n")), "language-words")
    n_words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counted.where(F.col("a") >= settings.least_count)
    # Numbers of frequent words fit 31 bits for any corpus; were they not to, the cast would fail rather than wrap.
    dictionary = stored(
        global_positions(frequent, ["lang", "word"], "code", 1).withColumn("code", F.col("code").cast("int")), "frequent-words"
    )
    codes = stored(global_codes(shards, dictionary, ["lang", "word"]), "shard-codes")
    phrases = stored(phrase_counts(shards, codes, n_words, settings), "phrases")
    counts = phrases.unionByName(dictionary.select(F.array("code").alias("phrase"), "a"))
    scored = worst_cuts(phrases, counts, settings)
    longest = phrases.where(F.size("phrase") > 2).select(F.explode(inner_phrases("phrase")).alias("phrase"), F.col("a").alias("longer")).groupBy(
        "phrase"
    ).agg(F.max("longer").alias("longer"))
    open_ = scored.join(longest, "phrase", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < settings.cover * F.col("a")))
    of_word = dictionary.select(F.col("code").alias("__first"), "lang")
    placed = open_.withColumn("__first", F.get("phrase", F.lit(0))).join(of_word, "__first")
    # Ranks with ties first: only what may be in the report gets its words.
    best = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    short = stored(placed.withColumn("__rank", best).where(F.col("__rank") <= settings.top).drop("__rank", "__first", "longer"), "best-phrases")
    spelt = short.select(F.col("phrase").alias("words"), F.posexplode("phrase").alias("at", "code")).join(
        dictionary.select("code", "word"), "code"
    ).groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    text_of = spelt.select("words", F.array_join("spelt.word", " ").alias("text"))
    final = short.withColumnRenamed("phrase", "words").join(text_of, "words").join(totals, "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    return final.withColumn("rank", rank.cast("long")).where(F.col("rank") <= settings.top).select(
        "lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score"
    )


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces
), f AS (
  SELECT lang, k, ws[i:i + k - 1] AS phrase, count(*) AS a
  FROM w, unnest(range(1, 5)) AS x(k), unnest(range(1, len(ws) - k + 2)) AS y(i) GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE k > 1 AND a >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, h.a AS l, t.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (h.a + t.a) AS score
  FROM c, unnest(range(1, c.k)) AS x(cut)
  JOIN f h ON h.lang = c.lang AND h.phrase = c.phrase[1:cut] JOIN f t ON t.lang = c.lang AND t.phrase = c.phrase[cut + 1:c.k]
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, phrase[i:i + m - 1] AS phrase, max(a) AS longer
  FROM c, unnest(range(2, k)) AS x(m), unnest(range(1, k - m + 2)) AS y(i) GROUP BY ALL
), open_ AS (
  SELECT w.*, array_to_string(w.phrase, ' ') AS text FROM worst w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * w.a
)
SELECT lang, rank, text AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM (
  SELECT o.*, t.n, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, text) AS rank
  FROM open_ o JOIN totals t ON t.lang = o.lang
) WHERE rank <= 2000
"""

"""How filters act on each other: what every filter removes after every order of the others.

Tasks code their own words, a dictionary of the whole table renumbers them, and documents become rows of a sparse document-term
matrix in CSR shards: ``offsets`` bound each row's entries, ``columns`` are the words' numbers, ``times`` their counts. A row's sum is the document's
number of words and its number of entries that of different words. These decide two filters; the other three are flags of the
text. Documents then count by the set of filters that they fail, of which there are 32 per part, and only those counts meet
the 120 orders.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.llm.common import documents, ship_package, stored, text_or_empty
from mnemoria.llm.terms import SHARD_WORDS, Vocabulary, one_list, packed, shard_number, unpacked

#: Different words after which a task begins a new unit, and words of all units in a part of the dictionary.
UNIT_WORDS, PART_WORDS = 500_000, 500_000
#: Words that become Python strings at once.
SLICE = 65_536
LETTERS = "ABCDE"
ORDERS = ["".join(order) for order in itertools.permutations(LETTERS)]


@dataclass(frozen=True)
class Rules:
    #: A fails below this number of words, B below this share of different words, in hundredths.
    least_words: int = 100
    least_distinct: int = 80
    #: C fails above this share of letters A to Z, in hundredths; D on any of these signs.
    most_capitals: int = 10
    signs: str = "#$%&*|"


@dataclass(frozen=True)
class Matrix:
    """``dictionary`` (part, first, words): the word at place i of a row has the number first + i, from 0 without gaps.
    ``coded`` has shards under the codes of their units, and before the shards of a unit, in rows of their own, the numbers of these codes."""

    dictionary: DataFrame
    coded: DataFrame
    kept: tuple[str, ...]

    @property
    def shards(self) -> DataFrame:
        """(offsets, columns, times, and a list per column of ``kept``): rows of the matrix."""
        names = ["offsets", "columns", "times", *self.kept]
        kinds = {f.name: f.dataType.simpleString() for f in self.coded.schema}
        kinds |= {"offsets": "array<int>", "columns": "array<bigint>", "times": "array<int>"}
        return self.coded.mapInArrow(renumbering(names), ", ".join(f"`{c}` {kinds[c]}" for c in names))


def local_shards(docs: DataFrame, text: str, keep: list[str], shard_words: int, unit_words: int) -> DataFrame:
    """CSR shards under the codes of a unit's own words, and one row with these ``words`` per unit.

    A shard's offsets, columns and times are ``packed`` in ``__csr``, for ``__n_rows`` rows and ``__n_entries`` entries.

    A unit is a run of shards of one task, which ends when it has ``unit_words`` different words. Null texts are rows without entries.
    """
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(text).cast("binary").alias("__text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = "unit bigint, words array<string>, __n_rows int, __n_entries int, __csr binary" + "".join(
        f", `{c}` array<{kinds[c]}>" for c in keep
    )
    names = ["unit", "words", "__n_rows", "__n_entries", "__csr", *keep]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are held as the codes of their words, four bytes each, never as the words.
        task, made, held, n, words = TaskContext.get().partitionId(), 0, [], 0, Vocabulary()
        columns: list[list[pa.Array]] = [[] for _ in keep]
        kinds_of: list[pa.DataType] = []

        def unit() -> pa.Array:
            return pa.array([shard_number(task, made)], pa.int64())

        def csr() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            codes = np.concatenate(held)
            width = max(len(words), 1)
            entry, times = np.unique(np.repeat(np.arange(len(held)), sizes) * width + codes, return_counts=True)
            offsets = np.searchsorted(entry, np.arange(len(held) + 1) * width)
            sizes = [pa.array([n], pa.int32()) for n in (len(held), len(entry))]
            data = pa.array([packed(*[x.astype(np.int32) for x in (offsets, entry % width, times)])], pa.binary())
            lists = [one_list(pa.concat_arrays(parts)) for parts in columns]
            return pa.RecordBatch.from_arrays([unit(), pa.nulls(1, pa.list_(pa.string())), *sizes, data, *lists], names)

        def vocabulary() -> pa.RecordBatch:
            none = [pa.nulls(1, kind) for kind in (pa.int32(), pa.int32(), pa.binary(), *map(pa.list_, kinds_of))]
            return pa.RecordBatch.from_arrays([unit(), one_list(words.strings()), *none], names)

        for batch in batches:
            begin, texts = 0, batch.column(0)
            kinds_of = [batch.schema.field(name).type for name in keep]
            for i in range(len(texts)):
                found = (texts[i].as_py() or b"").split()
                held.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                n += len(held[-1])
                if n >= shard_words:
                    for parts, name in zip(columns, keep):
                        parts.append(batch.column(name).slice(begin, i + 1 - begin))
                    yield csr()
                    held, n, begin, columns = [], 0, i + 1, [[] for _ in keep]
                    if len(words) >= unit_words:
                        yield vocabulary()
                        made, words = made + 1, Vocabulary()
            if begin < len(texts):
                for parts, name in zip(columns, keep):
                    parts.append(batch.column(name).slice(begin))
        if held:
            yield csr()
        if kinds_of:
            yield vocabulary()

    return narrow.mapInArrow(encode, schema)


def dictionary_parts(vocabularies: DataFrame, part_words: int) -> tuple[DataFrame, DataFrame]:
    """(dictionary, codes) of rows (unit, words): ``codes`` has (unit, n, codes, first), one row per unit and part: places
    in the unit's words and codes in the part, ``packed``; numbers are first + code.

    Words are dealt out to parts by their hash, a list per unit and part; in a part, a word that several units have gets one
    number. A part holds ``part_words`` of the units' words on average, and a word is there once per unit.
    """
    total = vocabularies.agg(F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()[0]
    parts = max(int(vocabularies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_words))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for unit, words in zip(batch.column(0), batch.column(1)):
                words = words.values
                each = itertools.chain.from_iterable(words.slice(at, SLICE).to_pylist() for at in range(0, len(words), SLICE))
                part = np.fromiter((xxhash.xxh32_intdigest(w) % parts for w in each), np.int64, len(words))
                order = np.argsort(part, kind="stable")
                for places in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(places):
                        own = [pa.array([part[places[0]]], pa.int64()), pa.array([unit.as_py()], pa.int64())]
                        locals_ = pa.array([packed(places.astype(np.int32))], pa.binary())
                        listed = one_list(words.take(pa.array(places)))
                        yield pa.RecordBatch.from_arrays([*own, locals_, listed], ["part", "unit", "locals", "words"])

    def number(table: pa.Table) -> pa.Table:
        lists = [x.values for x in table.column("words")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        n = table.num_rows
        sizes = list(map(len, lists))
        places = [np.frombuffer(unpacked(x, 4 * size), np.int32) for x, size in zip(table.column("locals"), sizes)]
        indices = np.split(coded.indices.to_numpy(), np.cumsum(sizes)[:-1])
        codes = [packed(at, own.astype(np.int32)) for at, own in zip(places, indices)]
        # The last row, that of the words, has no codes.
        out = {
            "part": pa.array([table.column("part")[0].as_py()] * (n + 1), pa.int64()),
            "unit": pa.array([*table.column("unit").to_pylist(), None], pa.int64()),
            "n": pa.array([*sizes, None], pa.int32()),
            "n_words": pa.array([*[None] * n, len(coded.dictionary)], pa.int64()),
            "codes": pa.array([*codes, None], pa.binary()),
            "words": pa.array([*[None] * n, coded.dictionary], pa.list_(pa.string())),
        }
        return pa.table(out)

    dealt = vocabularies.select("unit", "words").mapInArrow(deal, "part bigint, unit bigint, locals binary, words array<string>")
    schema = "part bigint, unit bigint, n int, n_words bigint, codes binary, words array<string>"
    numbered = stored(dealt.groupBy("part").applyInArrow(number, schema), "term-dictionary")
    # Rows are told apart by a number: a test of the words would read them all.
    words = numbered.where("n IS NULL").select("part", "n_words", "words")
    # One row per part: a few thousand words of bookkeeping for a billion of words.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = words.select("part", F.coalesce(F.sum("n_words").over(before), F.lit(0)).alias("first"))
    codes = numbered.where("n IS NOT NULL").join(firsts, "part").select("unit", "n", "codes", "first")
    return words.join(firsts, "part").select("part", "first", "words"), codes


def document_term_matrix(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, shard_words: int = SHARD_WORDS, unit_words: int = UNIT_WORDS
) -> Matrix:
    """The matrix of the white-space words of ``text``, case kept; a row per row of ``docs``, repeated ones too.

    ``keep`` names columns that go with the rows. Null and empty texts are rows without entries; an empty table has no shard.
    """
    keep = ["doc_id"] if keep is None else keep
    local = stored(local_shards(docs, text, keep, shard_words, unit_words), "term-shards")
    dictionary, codes = dictionary_parts(local.where("__n_rows IS NULL"), PART_WORDS)
    shards = local.where("__n_rows IS NOT NULL").drop("words")
    # A shard never carries its unit's codes: they come before it, in the short rows of their parts, once for all shards of the unit.
    pieces = codes.select("unit", *[F.col(c).alias(f"__{c}") for c in ("n", "codes", "first")])
    both = shards.unionByName(pieces, allowMissingColumns=True).repartition("unit")
    return Matrix(dictionary, both.sortWithinPartitions("unit", F.col("__csr").isNotNull()), tuple(keep))


def renumbering(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of ``Matrix.coded`` to those of ``Matrix.shards``, one at a time. Of the numbers, those of one unit are held."""

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, places, numbers, of = None, [], [], None
        for batch in batches:
            for i, own in enumerate(batch.column("unit").to_pylist()):
                if own != unit:
                    unit, places, numbers, of = own, [], [], None
                if not batch.column("__csr")[i].is_valid:
                    size = batch.column("__n")[i].as_py()
                    at, codes = np.frombuffer(unpacked(batch.column("__codes")[i], 8 * size), np.int32).reshape(2, size)
                    places.append(at)
                    numbers.append(codes.astype(np.int64) + batch.column("__first")[i].as_py())
                    continue
                if of is None:
                    # A unit of empty texts has no word and thus no codes.
                    of = np.zeros(sum(map(len, places)), dtype=np.int64)
                    for at, values in zip(places, numbers):
                        of[at] = values
                    places, numbers = [], []
                n_rows, n_entries = (batch.column(c)[i].as_py() for c in ("__n_rows", "__n_entries"))
                data = np.frombuffer(unpacked(batch.column("__csr")[i], 4 * (n_rows + 1 + 2 * n_entries)), np.int32)
                offsets, columns, times = np.split(data, [n_rows + 1, n_rows + 1 + n_entries])
                csr = {"offsets": pa.array(offsets), "columns": pa.array(of[columns]), "times": pa.array(times)}
                values = [one_list(csr[name]) if name in csr else batch.column(name).slice(i, 1) for name in names]
                yield pa.RecordBatch.from_arrays(values, names)

    return renumber


def row_counts(matrix: Matrix) -> DataFrame:
    """The kept columns of each row with ``n_words``, the sum of its entries, and ``n_distinct``, the number of its columns.

    A shard is renumbered and counted in one Python worker: as two steps, each task would have two that hold it.
    """
    kept = list(matrix.kept)
    renumber = renumbering(["offsets", "columns", "times", *kept])
    kinds = {f.name: f.dataType.elementType.simpleString() for f in matrix.coded.schema if f.name in kept}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in renumber(batches):
            bounds, words, times = (shard.column(c)[0].values.to_numpy() for c in ("offsets", "columns", "times"))
            n = len(bounds) - 1
            row = np.repeat(np.arange(n), np.diff(bounds))
            held = times.astype(np.int64) * (words >= 0)
            total = np.bincount(row, held, n).astype(np.int64)
            distinct = np.bincount(row, held > 0, n).astype(np.int64)
            lists = [shard.column(c)[0].values for c in kept]
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(distinct), *lists], ["n_words", "n_distinct", *kept])

    return matrix.coded.mapInArrow(count, "n_words bigint, n_distinct bigint" + "".join(f", `{c}` {kinds[c]}" for c in kept))


def failing(docs: DataFrame, text: str = "text", part: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, part, failing, n_words, n_distinct) per row of ``docs``: the letters of the filters that it fails, in order.

    A: too few words. B: too few different ones. C: too many capitals. D: any of the signs. E: the text of a smaller doc_id. Null
    texts count as empty, a null part as an empty string. Rows without an id neither fail E nor make others fail; of rows alike in
    id and text, none fails E by the other.
    """
    whole = text_or_empty(text)
    narrow = docs.select(
        whole.alias("__text"), "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        (100 * F.regexp_count(whole, F.lit("[A-Z]")) > rules.most_capitals * F.length(whole)).alias("c"),
        whole.rlike("[" + "".join("\\" + s for s in rules.signs) + "]").alias("d"),
        F.sha2(whole, 256).alias("digest"),
    )
    kept = ["doc_id", "part", "c", "d", "digest"]
    rows = stored(row_counts(document_term_matrix(narrow, "__text", kept)), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A text with very many copies is the skewed side of this join, which adaptive execution splits.
    told = rows.join(firsts, "digest", "left")
    tests = {
        "A": F.col("n_words") < rules.least_words,
        "B": 100 * F.col("n_distinct") < rules.least_distinct * F.col("n_words"),
        "C": F.col("c"),
        "D": F.col("d"),
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }
    letters = F.concat(*[F.when(test, letter).otherwise("") for letter, test in tests.items()])
    return told.select("doc_id", "part", letters.alias("failing"), "n_words", "n_distinct")


def interactions(flags: DataFrame) -> DataFrame:
    """Counts per part, order and step of rows (part, failing, good, toxic).

    The rows are first counted per part and set of failed filters, so the orders multiply at most 32 rows per part.
    """
    one = F.count("*").alias("n")
    good, toxic = (F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic"))
    sets = flags.groupBy("part", "failing").agg(one, good, toxic)
    steps = [
        {"filter_order": order, "step": i + 1, "letter": letter, "earlier": order[:i]} for order in ORDERS for i, letter in enumerate(order)
    ]
    kind = "array<struct<filter_order: string, step: int, letter: string, earlier: string>>"
    # The few sets are written first: their counting and the orders compile apart.
    met = stored(sets, "audit-sets").select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    fails = F.contains("failing", F.col("letter"))
    gone = F.expr("translate(failing, earlier, '') <> failing")
    # Of the orders of k failed filters, each is the first in one k-th.
    share = F.expr(f"n * ({len(ORDERS)} div greatest(length(failing), 1))")

    def total(test: Column, of: Column | str, name: str) -> Column:
        return F.sum(F.when(test, of).otherwise(F.lit(0))).cast("long").alias(name)

    return met.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails, F.col("n"), "kept"),
        total(~gone & fails, F.col("n"), "removed"),
        total(gone & fails, F.col("n"), "redundant"),
        total(F.col("failing") == F.col("letter"), F.col("n"), "unique_fails"),
        total(~gone & fails, F.col("good"), "good_lost"),
        total(~gone & fails, F.col("toxic"), "toxic_lost"),
        total(fails, share, "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``labels`` (doc_id, quality, toxic) may cover some documents; of several labels of one document, any 1 counts. An empty table
    gives no row, as it has no part.
    """
    marks = labels.groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    told = failing(docs, text, part, rules).join(marks, "doc_id", "left")
    no = F.lit(False)
    return interactions(told.select("part", "failing", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), firsts AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN w.doc_id > firsts.first THEN 'E' ELSE '' END) AS failing
  FROM w JOIN firsts ON w.t = firsts.t LEFT JOIN marks ON w.doc_id = marks.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters x ON x.c NOT IN (a.c, b.c)
  JOIN letters y ON y.c NOT IN (a.c, b.c, x.c) JOIN letters z ON z.c NOT IN (a.c, b.c, x.c, y.c)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, unnest(range(1, 6)) AS s(step)
), sets AS (
  SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, failing
), met AS (
  SELECT *, contains(failing, f) AS fails, translate(failing, earlier, '') <> failing AS gone FROM sets CROSS JOIN steps
), counts AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE failing = f), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counts
"""

"""Lines repeated across documents, exactly or within a few edits, by a segment-partition join.

A line of length l is cut into one segment more than the edits allowed, so a line within the threshold holds one of
them unchanged, at a place that the lengths bound. Lines are indexed under (length, segment, substring) and probe the
indexes of their own and the next shorter lengths. Lines that meet are first compared by the parities of their short
character runs, of which an edit changes few, then by a banded bit-parallel edit distance. Chains of links form a class, of
which the first line stays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.llm.common import WORD, documents, ship_package, stored, text_or_empty
from mnemoria.llm.components import linked_classes
from mnemoria.llm.screen import screened

SPACES = " \t\x0b\x0c\r"
SEEN = 200_000


@dataclass(frozen=True)
class Settings:
    #: Most edits (code points inserted, deleted or replaced) between linked lines.
    edits: int = 2
    #: Lines of fewer code points take no part; those of fewer than ``near_chars`` are only compared for equality.
    least_chars: int = 10
    near_chars: int = 30


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the ``edits + 1`` segments of a line, the longer ones last."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def substrings(length: int, edits: int, least: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings under which a line of ``length`` is looked up.

    With i segments before it and the rest after, a matching segment can have moved by at most i edits seen from the
    left, and by at most ``edits - i`` seen from the right end.
    """
    out = []
    for indexed in range(max(least, length - edits), length + 1):
        gap = length - indexed
        for i, (start, size) in enumerate(segments(indexed, edits)):
            low = max(start - i, start + gap - (edits - i), 0)
            high = min(start + i, start + gap + (edits - i), length - size)
            out += [(indexed, i, at, size) for at in range(low, high + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``, by a band of diagonals held in bits.

    Common ends are cut off first. Bit d + edits of row e is set if, with the part of ``b`` read so far, the place in ``a``
    that is d ahead can be reached by e edits; all diagonals of the band move at once with each character.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    same = shared_prefix(a, b)
    a, b = a[same:], b[same:]
    same = shared_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | 1 << i + edits
    band = (1 << 2 * edits + 1) - 1
    rows = [sum(1 << edits + d for d in range(e + 1)) for e in range(edits + 1)]
    for j, char in enumerate(b):
        match = places.get(char, 0) >> j & band
        before, after = rows[0], rows[0] & match
        rows[0] = after
        for e in range(1, edits + 1):
            # kept by a match; replaced; inserted in b; deleted from a
            found = (rows[e] & match | before | before >> 1 | after << 1) & band
            before, after = rows[e], found
            rows[e] = found
        if not after:
            return False
    return bool(rows[edits] >> edits + len(a) - len(b) & 1)


def shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: Parities of character runs: (length of the runs, 64-bit words). An edit changes as many runs on either side.
PARITIES = ((1, 1), (2, 2), (3, 4))


def parities(line: str) -> list[int]:
    """For each length of ``PARITIES``, whether the runs of that many characters that hash to a bit are odd in number.

    An edit takes at most ``length`` runs out and puts as many in, so it flips at most twice that many bits.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = []
    for length, words in PARITIES:
        h = np.zeros(max(0, len(codes) - length + 1), dtype=np.uint64)
        for i in range(length):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - length + 1 + i]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
        out += np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()
    return out


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """Whether the parities of two lines differ by no more than ``edits`` edits can make them."""
    at, tests = 0, []
    for length, words in PARITIES:
        bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(at, at + words)]
        tests.append(functools.reduce(lambda x, y: x + y, bits) <= 2 * length * edits)
        at += words
    return functools.reduce(lambda x, y: x & y, tests)


def bare_lines(text: Column | str) -> Column:
    """The lines of a text without white space at their ends."""
    return F.transform(F.split(text_or_empty(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


@functools.lru_cache(maxsize=4096)
def plan(length: int, edits: int, least: int) -> list[tuple[int, int, int]]:
    """(hash seed, start, end) of ``substrings``; the seed tells indexed length and segment."""
    return [(indexed * (edits + 1) + i, at, at + size) for indexed, i, at, size in substrings(length, edits, least)]


def looked_up(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(bucket, node): hashes of each longer line and of the substrings it is indexed and looked up under.

    A task gives a line only once while it remembers it, so a line on every page adds a few rows per task.
    """
    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest, seen, buckets, nodes = xxhash.xxh64_intdigest, set(), [], []

        def frame() -> pd.DataFrame:
            out = {"bucket": np.array(buckets, dtype=np.uint64).view(np.int64), "node": np.array(nodes, dtype=np.uint64).view(np.int64)}
            buckets.clear(), nodes.clear()
            return pd.DataFrame(out)

        for batch in batches:
            for whole in batch["text"]:
                for line in (whole or "").split("\n"):
                    line = line.strip(SPACES)
                    if len(line) < settings.near_chars:
                        continue
                    node = digest(line.encode("utf-8", "surrogatepass"), 42)
                    if node in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    for seed, start, end in plan(len(line), settings.edits, settings.near_chars):
                        buckets.append(digest(line[start:end].encode("utf-8", "surrogatepass"), seed))
                        nodes.append(node)
                if len(buckets) > 400_000:
                    yield frame()
        yield frame()

    return docs.select(F.col(text).alias("text")).mapInPandas(emitted, "bucket long, node long")


def near_classes(docs: DataFrame, text: str, settings: Settings) -> DataFrame:
    """(node, root) of the lines that are within ``settings.edits`` of another text; nodes are hashes of lines."""
    ship_package(docs.sparkSession)
    whole = W.partitionBy("bucket")
    met = looked_up(docs, text, settings).withColumns({"low": F.min("node").over(whole), "high": F.max("node").over(whole)})
    shared = stored(met.where("low < high").select("bucket", "node").distinct(), "line-buckets")
    wanted = stored(shared.select(F.col("node").alias("key")).distinct(), "line-nodes")
    lines = docs.select(F.explode(bare_lines(text)).alias("line")).where(F.length("line") >= settings.near_chars)

    @F.pandas_udf("array<bigint>")
    def parities_of(column: pd.Series) -> pd.Series:
        return column.map(parities)

    texts = stored(
        screened(lines, F.xxhash64("line"), wanted).groupBy(F.xxhash64("line").alias("node")).agg(F.min("line").alias("line"))
        .withColumn("payload", parities_of("line")),
        "line-texts",
    )
    placed = stored(shared.join(texts.select("node", "payload"), "node"), "line-payloads")

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, settings.edits) for x, y in zip(a, b)], dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("node").alias(n), F.col("line").alias(f"line_{n}")) for n in "ab")
        return pairs.join(a, "a").join(b, "b").where(close("line_a", "line_b"))

    return linked_classes(lambda: placed, lambda a, b: may_be_near(a, b, settings.edits), verify=verify)


def repeated_lines(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(documents, dropped) of ``docs`` (doc_id, text).

    documents: doc_id, mark (a hash of the text), n_lines, one row per row of ``docs``; n_lines counts lines that take
    part. dropped: doc_id, mark, and ``lines`` as (no, near), the lines that go, by number from 0; ``near`` if the line
    that stays is not the same. Of the lines of a class the first stays, by doc_id (null last), hash of the text and number.
    Rows alike in id and text count as one document. Null texts have no lines.
    """
    cut = F.transform(
        bare_lines(text),
        lambda x, i: F.struct(
            i.alias("no"), F.xxhash64(x).alias("node"), F.xxhash64(x, F.lit(1)).alias("check"), F.length(x).alias("chars")
        ),
    )
    rows = stored(
        docs.select(
            "doc_id", F.xxhash64(text).alias("mark"),
            F.transform(F.filter(cut, lambda x: x["chars"] >= settings.least_chars), lambda x: x.dropFields("chars")).alias("lines"),
        ),
        "lines",
    )
    roots = near_classes(docs, text, settings)
    each = rows.select("doc_id", "mark", F.explode("lines").alias("line")).select("doc_id", "mark", "line.*")
    placed = stored(
        each.join(roots, "node", "left").select(
            "doc_id", "mark", "no", "node", F.coalesce("root", "node").alias("class"),
            F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("check"),
        ),
        "line-classes",
    )
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "no")
    firsts = stored(
        placed.groupBy("class", "check").agg(F.min(F.struct(at.alias("at"), "node")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("class", "check", "first.at", F.col("first.node").alias("stays")),
        "first-lines",
    )
    later = placed.join(firsts, ["class", "check"]).where(at != F.col("at"))
    dropped = later.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("no", (F.col("node") != F.col("stays")).alias("near")))).alias("lines")
    )
    return rows.select("doc_id", "mark", F.size("lines").alias("n_lines")), dropped


def whole_copies(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, mark, copy) of the documents whose whole text is that of an earlier one, by doc_id (null last)."""
    keys = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.xxhash64(text, F.lit(1)).alias("check")).distinct()
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    firsts = keys.groupBy("mark", "check").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    return keys.join(firsts.drop("n"), ["mark", "check"]).where(at != F.col("first")).select("doc_id", "mark", F.lit(True).alias("copy"))


def without_repeated_lines(
    docs: DataFrame, text: str = "text", settings: Settings = Settings(), keep_short: bool = False
) -> DataFrame:
    """``docs`` with the dropped lines cut out of ``text``; a document all of whose lines that take part were dropped is gone.

    With ``keep_short``, such a document is gone only if no word is left, or if its whole text is that of an earlier document, with
    which its short lines stay. Lines too short to take part stay otherwise, and texts that lose nothing stay as they are.
    """
    _, dropped = repeated_lines(docs, text, settings)
    gone = dropped.select("doc_id", "mark", F.transform("lines", lambda x: x["no"]).alias("__gone"))
    if keep_short:
        copies = whole_copies(docs, text).select(F.col("doc_id").alias("i"), F.col("mark").alias("m"), F.col("copy").alias("__copy"))
        gone = gone.join(copies, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    gone = gone.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")), "left")
    # Few lines go from a document as a rule; a map look-up would not be faster.
    kept = F.array_join(
        F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False))), "\n"
    )
    taking_part = F.size(F.filter(bare_lines(text), lambda x: F.length(x) >= settings.least_chars))
    cut = joined.withColumn("__kept", F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    stays = F.size("__gone") < taking_part
    if keep_short:
        stays = F.col("__kept").rlike(WORD) & F.col("__copy").isNull()
    return cut.where(F.col("__gone").isNull() | stays).withColumn(text, F.col("__kept")).select(*docs.columns)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, those dropped (equal and near), and their numbers."""
    rows, dropped = repeated_lines(documents(spark, sf_dir))
    gone = dropped.select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), F.col("lines").alias("gone"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    near = F.size(F.filter("gone", lambda x: x["near"]))
    return joined.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(near, F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.transform("gone", lambda x: x["no"].cast("string")), ","), F.lit("")).alias("dropped_lines"),
    )

"""SimHash near-duplicates by a grid range-join over counts of set bits.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment mapped to its number of set bits. The
Manhattan distance of two such vectors is a lower bound of the number of differing bits. At 4 differing bits or fewer, it is at
most 2 over the first 17 segments or at most 1 over the other 15. The grid has one cell per vector: two points at distance
2 share a cell next to both, and of two points at distance 1 the upper is next to the lower one's cell. Fingerprints that share
a cell are verified on their bits. This finds every link of one 64-bit fingerprint.

A similarity of 0.8 is about 15 % of the bits, too far for neighbouring cells. ``WIDE`` therefore links by the sets of
shingles themselves: bands of minima only propose pairs, the parities of a set bound how far two sets differ at least, and
what is left is compared on the whole sets of shingle hashes. A link is exact; a pair at the very threshold is proposed but
for about 5 in 100 million, a more similar one more surely.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.llm.common import documents, ship_package, stored
from mnemoria.llm.components import linked_classes
from mnemoria.scale import connected

MAX_BITS = 4
BLOCK = 255  # rows that eight-bit counters can hold
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    #: Words in a shingle.
    words: int = 4
    #: Fingerprints of 64 bits per document.
    lanes: int = 1
    #: Parts of the grid, as (first segment, segments, reach): the Manhattan distance within which all points share a cell.
    parts: tuple[tuple[int, int, int], ...] = ((0, 17, 2), (17, 15, 1))
    #: Most differing bits in the lane whose cell is shared, and over all lanes.
    lane_bits: int = MAX_BITS
    total_bits: int = MAX_BITS
    seed: int = 42


@dataclass(frozen=True)
class Sets:
    """Links between documents whose sets of shingles have a Jaccard similarity of ``least`` or more."""

    words: int = 5
    #: The similarity as a fraction, so that the comparison is one of whole numbers.
    least: tuple[int, int] = (4, 5)
    #: A pair is compared if it agrees in all the minima of a band: at 0.8, all bands miss it with (1 - 0.8 ** 4) ** 32.
    bands: int = 32
    minima: int = 4
    #: 64-bit words that hold the parities of a set, of which an element in only one of two sets flips one bit.
    parity_words: int = 16
    seed: int = 42


WIDE = Sets()


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words if they are fewer; none for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1]
    return np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(starts)
    )


def fingerprints(hashes: np.ndarray, lanes: int) -> list[int]:
    """The bits set in over half of the hashes, as signed 64-bit numbers. Lanes after the first mix the hashes anew."""
    counts = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = mixed(hashes[at : at + BLOCK], lanes).view(np.uint8).reshape(-1, 8 * lanes)
        counts += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64).tolist()


def mixed(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(hashes, lanes): the hashes as they are, then under other finalisers."""
    out = hashes[:, None] ^ (np.arange(lanes, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    rest = out[:, 1:]
    rest *= _U(0xBF58476D1CE4E5B9)
    rest ^= rest >> _U(31)
    rest *= _U(0x94D049BB133111EB)
    rest ^= rest >> _U(29)
    return np.ascontiguousarray(out)


def with_fingerprints(docs: DataFrame, settings: Settings, text: str = "text", out: str = "lanes") -> DataFrame:
    """``docs`` with ``out``, an array of ``settings.lanes`` fingerprints of the whole text."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def lanes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = (shingle_hashes(t, settings.words, settings.seed) for t in texts)
            yield pd.Series([fingerprints(h, settings.lanes) for h in rows])

    return docs.withColumn(out, lanes(F.col(text)))


def signature(hashes: np.ndarray, settings: Sets) -> list[int]:
    """Two digests of the set of hashes, its size and parities, then its bands (none if it is empty), as signed numbers."""
    import xxhash

    found = np.unique(hashes)
    raw = found.tobytes()
    wide = 64 * settings.parity_words
    odd = np.bincount(((found >> _U(32)) % _U(wide)).astype(np.int64), minlength=wide) & 1
    head = [xxhash.xxh64_intdigest(raw, settings.seed), xxhash.xxh64_intdigest(raw, settings.seed + 1), len(found)]
    parts = [np.array(head, dtype=np.uint64), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)]
    if len(found):
        factors = np.random.default_rng(settings.seed).integers(0, 2**64, settings.bands * settings.minima, np.uint64) | _U(1)
        blocks = (found[at : at + 512, None] * factors for at in range(0, len(found), 512))
        least = functools.reduce(np.minimum, (b.min(axis=0) for b in blocks)).reshape(settings.bands, settings.minima)
        parts.append(np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], dtype=np.uint64))
    return np.concatenate(parts).view(np.int64).tolist()


def with_signatures(docs: DataFrame, settings: Sets, text: str) -> DataFrame:
    """``docs`` with ``lanes`` (two digests, equal for equal sets), ``size``, ``parities`` and ``bands`` of the whole text."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signature(shingle_hashes(t, settings.words, settings.seed), settings) for t in texts])

    first = 4 + settings.parity_words
    return docs.withColumn("__signature", signatures(F.col(text))).select(
        *docs.columns, F.slice("__signature", 1, 2).alias("lanes"), F.get("__signature", F.lit(2)).alias("size"),
        F.slice("__signature", 4, settings.parity_words).alias("parities"),
        F.slice("__signature", first, settings.bands).alias("bands"),
    )


def set_classes(nodes: DataFrame, docs: DataFrame, text: str, settings: Sets) -> DataFrame:
    """(node, root) of the ``nodes`` (node, size, parities, bands, of: a document's id and mark) that have a link."""
    ship_package(docs.sparkSession)
    over, under = settings.least

    def sizes_allow(a: Column, b: Column) -> Column:
        return under * F.least(a, b) >= over * F.greatest(a, b)

    def parities_allow(a: Column, b: Column) -> Column:
        bits = [
            F.bit_count(F.get(a["parities"], F.lit(i)).bitwiseXOR(F.get(b["parities"], F.lit(i))))
            for i in range(settings.parity_words)
        ]
        return (under + over) * functools.reduce(lambda x, y: x + y, bits) <= (under - over) * (a["size"] + b["size"])

    @F.pandas_udf("array<bigint>")
    def shingle_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = (np.unique(shingle_hashes(t, settings.words, settings.seed)) for t in texts)
            yield pd.Series([r.view(np.int64).tolist() for r in rows])

    def verify(pairs: DataFrame) -> DataFrame:
        met = stored(pairs.select("a", "b"), "set-pairs")
        wanted = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        one = nodes.join(wanted, "node").select("node", F.col("of.doc_id").alias("__id"), F.col("of.mark").alias("__mark"))
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark"))
        texts = docs.select("doc_id", text).join(one, same).select("node", F.col(text).alias("__text")).dropDuplicates(["node"])
        sets = stored(texts.select("node", shingle_sets("__text").alias("shingles")), "shingle-sets")
        a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}")) for n in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        counted = met.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
        return counted.where((under + over) * F.col("both") >= over * F.col("all")).select("a", "b")

    return linked_classes(
        lambda: nodes.select(F.explode("bands").alias("bucket"), "node", F.col("size").alias("payload")), sizes_allow,
        nodes.select("node", F.struct("size", "parities").alias("detail")), parities_allow, verify,
    )


#: In ``packed``, two bits hold each segment's count of set bits, 0 to 2. A step up or down is an exclusive or.
_PACKED = "((payload & {m}L) ^ (shiftrightunsigned(payload, 1) & {m}L)) | shiftleft(payload & {m}L & shiftrightunsigned(payload, 1), 1)".format(
    m=0x5555555555555555)


def part_cells(number: int, first: int, count: int, reach: int) -> str:
    """SQL array of the cells of one part: the point's own and, by reach, those one step down, or down and up."""
    mask = ((1 << 2 * count) - 1) << 2 * first
    own = f"(packed & {mask - (1 << 64) if mask >= 1 << 63 else mask}L)"
    cells = [f"array(xxhash64(lane, {number}, {own}))"]
    for step, limit in ((1, "c > 0"), (0, "c < 2"))[:reach]:
        cells.append(
            f"filter(transform(sequence({first}, {first + count - 1}), i -> transform(array(shiftrightunsigned(packed, 2 * i) & 3), "
            f"c -> if({limit}, xxhash64(lane, {number}, {own} ^ shiftleft(if(c = {step}, 1L, 3L), 2 * i)), null))[0]), x -> x IS NOT NULL)"
        )
    return f"concat({', '.join(cells)})"


def cells(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, node, payload) of ``nodes`` (node, lanes): the cells of each lane's fingerprint, and that lane."""
    each = nodes.select("node", F.posexplode("lanes").alias("lane", "payload")).withColumn("packed", F.expr(_PACKED))
    parts = ", ".join(part_cells(i, *part) for i, part in enumerate(settings.parts))
    return each.select(F.explode(F.expr(f"concat({parts})")).alias("bucket"), "node", "payload")


def classes(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, root) of the ``nodes`` (node, lanes; distinct lanes) that have a link."""

    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= settings.lane_bits

    def exact(a: Column, b: Column) -> Column:
        bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(settings.lanes)]
        return functools.reduce(lambda x, y: x + y, bits) <= settings.total_bits

    if settings.lanes == 1:
        return linked_classes(lambda: cells(nodes, settings), near)
    return linked_classes(
        lambda: cells(nodes, settings), near, nodes.select("node", F.col("lanes").alias("detail")), exact
    )


def near_duplicates(docs: DataFrame, text: str = "text", settings: Settings | Sets = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, mark (a hash of the text), lanes, root, component_id.

    Documents with equal fingerprints, or with a chain of links between theirs, share a component: a number ``root``,
    named by its smallest doc_id (null if no member has one). Null, empty and wordless texts have fingerprint zero,
    linked as any other. Under ``Sets``, lanes are digests of the set of shingles, and all texts without a word are equal.
    """
    narrow = docs.select("doc_id", F.col(text).alias("__text"), F.xxhash64(text).alias("mark"))
    by_sets = isinstance(settings, Sets)
    signed = with_signatures(narrow, settings, "__text") if by_sets else with_fingerprints(narrow, settings, "__text")
    rows = stored(signed.drop("__text"), "fingerprints")
    # Equal lanes have equal sets, so any row of them will do.
    more = [F.first(c).alias(c) for c in ("size", "parities", "bands")] + [F.min(F.struct("doc_id", "mark")).alias("of")]
    distinct = rows.groupBy("lanes").agg(F.min("doc_id").alias("least"), *(more if by_sets else []))
    rows = rows.select("doc_id", "mark", "lanes")
    # Nodes are numbered by their smallest doc_id: the first text of a group is mostly the one that the others copy.
    numbered = distinct.repartitionByRange("least").sortWithinPartitions("least", "lanes")
    nodes = stored(numbered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = set_classes(nodes, docs, text, settings) if by_sets else classes(nodes, settings)
    placed = nodes.select("node", "lanes", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(names, "root").select("lanes", "root", "component_id"), "components")
    # Copies share their fingerprint: a hot one is the skewed side of this join, which adaptive execution splits.
    return rows.join(named, "lanes")


def joint_classes(docs: DataFrame, text: str, kinds: Sequence[Settings | Sets]) -> DataFrame:
    """(doc_id, mark, root, n) of each id and text, ``n`` rows of it: classes of the links of all ``kinds`` together."""
    by_kind = [near_duplicates(docs, text, kind).select("doc_id", "mark", F.lit(i).alias("kind"), "root") for i, kind in enumerate(kinds)]
    roots = [F.max(F.when(F.col("kind") == i, F.col("root"))).alias(f"root_{i}") for i in range(len(kinds))]
    rows = functools.reduce(DataFrame.unionByName, by_kind).groupBy("doc_id", "mark").agg(F.count_if(F.col("kind") == 0).alias("n"), *roots)
    if len(kinds) == 1:
        return rows.withColumnRenamed("root_0", "root")
    rows = stored(rows, "roots")
    # A class of a later kind joins the classes of the first that have a row in it.
    links = [
        rows.select("root_0", F.col(f"root_{i}").alias("other")).distinct()
        .join(rows.groupBy(F.col(f"root_{i}").alias("other")).agg(F.min("root_0").alias("a")), "other")
        .where("a <> root_0").select("a", F.col("root_0").alias("b"))
        for i in range(1, len(kinds))
    ]
    tops = connected(functools.reduce(DataFrame.unionByName, links)).select(F.col("node").alias("root_0"), F.col("root").alias("top"))
    return rows.join(tops, "root_0", "left").select("doc_id", "mark", F.coalesce("top", "root_0").alias("root"), "n")


def one_of_each(docs: DataFrame, text: str = "text", settings: Settings | Sets | Sequence[Settings | Sets] = WIDE) -> DataFrame:
    """``docs`` with one row per component: the smallest doc_id stays (null last), of repeated rows one.

    Several ``settings`` link together: by fingerprints and by sets of shingles, say.
    """
    kinds = [settings] if isinstance(settings, (Settings, Sets)) else list(settings)
    keys = stored(joint_classes(docs, text, kinds), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = keys.groupBy("root").agg(F.min(order).alias("stays"))
    marked = stored(keys.join(first, "root").select("doc_id", "mark", "n", (order == F.col("stays")).alias("stays")), "choice")

    def among(rows: DataFrame, how: str) -> DataFrame:
        chosen = rows.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark"))
        return docs.join(chosen, same, how)

    # As few documents go, the join is against those: small enough, adaptive execution broadcasts them.
    kept = among(marked.where(~F.col("stays") | (F.col("n") > 1)), "left_anti")
    repeated = marked.where(F.col("stays") & (F.col("n") > 1))
    if repeated.isEmpty():
        return kept
    return kept.unionByName(among(repeated, "left_semi").dropDuplicates(["doc_id", text]))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex(F.element_at("lanes", 1)), 16, "0"))
    return got.select("doc_id", digits.alias("fingerprint"), "component_id")

"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies (target over source size). Its fraction is rounded
by the pivotal method: two fractions meet, a fixed draw moves mass (words) from one to the other until one is 0 or 1,
and the other goes on. Documents meet in blocks of like size, the fraction left in each block meets those of other
blocks, and so on up a tree whose root is one fraction per source. The sum of words is thus kept at every node, and a
source misses its target by at most half of the one document left at its root.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from mnemoria.llm.common import WORD, documents, hash_share, stored, text_or_empty
from mnemoria.scale import global_positions

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 128

_UNIT = "struct<size:bigint,key:struct<{key}>,n:bigint,p:double,whole:bigint,source_size:bigint,target:double>"
# One block, folded from its largest unit down. ``carry`` is the unit x whose fraction is still open, y the next one;
# ``done`` has the decided units, with p 0 or 1. Either x takes words from y or y from x, as many as the giver has or
# the taker has room for; the draw weighs the two so that neither expectation changes. One of them is then decided.
_FOLD = """
aggregate(
  units,
  named_struct('carry', cast(null AS {unit}), 'done', cast(array() AS array<{unit}>)),
  (a, y) -> if(
    a.carry IS NULL,
    named_struct('carry', y, 'done', a.done),
    transform(
      array(named_struct(
        'x_has', a.carry.p * a.carry.size, 'x_room', (1 - a.carry.p) * a.carry.size,
        'y_has', y.p * y.size, 'y_room', (1 - y.p) * y.size,
        'u', pmod(xxhash64(a.carry.key, y.key, a.carry.size, y.size, {level}, {seed}), 9007199254740992L) / 9007199254740992D
      )),
      d -> if(
        d.u * (least(d.x_room, d.y_has) + least(d.y_room, d.x_has)) < least(d.y_room, d.x_has),
        if(d.x_room <= d.y_has,
           named_struct('carry', {y_less}, 'done', concat(a.done, array({x_1}))),
           named_struct('carry', {x_all}, 'done', concat(a.done, array({y_0})))),
        if(d.y_room <= d.x_has,
           named_struct('carry', {x_less}, 'done', concat(a.done, array({y_1}))),
           named_struct('carry', {y_all}, 'done', concat(a.done, array({x_0}))))
      )
    )[0]
  )
)
"""


def word_count(text: str) -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(text), F.lit(WORD), 0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target), one row per source, from rows of (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all sizes by them. A target
    stops at ``most`` times its source's size, and the excess is shared by weight among the others until none is above.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = global_positions(sums, [F.col("source").isNull().alias("none"), F.col("source")], "place")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(placed.select("source", "source_size", turn.alias("weight")), "mix-sources")
    cap = F.col("source_size") * most
    rate, stopped = 0.0, -1
    while True:  # ends: a stopped source stays stopped, as the rate only rises
        above = F.col("weight") * F.lit(rate) > cap
        got = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(above, 1)).alias("stopped"),
        ).first()
        if got["stopped"] == stopped or not got["open"]:
            break
        stopped = got["stopped"]
        rate = (got["total"] - got["full"]) / got["open"]
    target = F.least(F.col("weight") * F.lit(rate), cap.cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def copies(sizes: DataFrame, key: list[str], seed: int = 17, weights: tuple[float, ...] = WEIGHTS,
           most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """How often the mix takes each row of ``sizes`` (key columns, source, size): ``n`` equal rows share ``total`` copies.

    One result row per distinct (key, source, size): key columns, source, size, source_size, target, n, total. Equal
    rows are interchangeable and rounded as one; a document of size 0 is never taken. ``total`` is at most
    ``most * n``, and does not depend on the order or the partitions of the input.
    """
    spark = sizes.sparkSession
    units = sizes.groupBy(*key, "source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    mass = F.col("n") * F.coalesce(ratio, F.lit(0.0))
    joined = units.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    keyed = joined.select(
        "source", "size", F.struct(*key).alias("key"), "n", "source_size", "target",
        F.floor(mass).alias("whole"), (mass - F.floor(mass)).alias("p"),
        F.floor(4 * F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int").alias("class"),
    )
    unit = _UNIT.format(key=",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sizes.select(*key).schema))
    rows = stored(keyed, "mix-units")
    idle = rows.where("size = 0 OR p = 0")
    active = rows.where("size > 0 AND p > 0")

    counts = active.groupBy("source", "class").agg(F.count("*").alias("units"))
    slices = stored(
        counts.select(F.col("source").alias("__source"), F.col("class").alias("__class"),
                      F.ceil(F.col("units") / block).alias("slices")), "mix-slices")
    most_slices = slices.agg(F.coalesce(F.max("slices"), F.lit(1)).alias("m")).first()["m"]
    placed = active.join(
        slices, F.col("source").eqNullSafe(F.col("__source")) & (F.col("class") == F.col("__class"))
    ).withColumn("slice", F.floor(hash_share("key", "size", F.lit(seed)) * F.col("slices")).cast("long"))
    one = F.struct("size", "key", "n", "p", "whole", "source_size", "target").cast(unit)
    open_units = placed.select("source", "class", "slice", one.alias("unit"))

    depth = max(1, math.ceil(math.log(max(most_slices, 2), block)))
    done = []
    for level in range(depth + 2):
        if level:
            open_units = open_units.withColumn("slice", F.floor(F.col("slice") / block).cast("long"))
        if level == depth + 1:  # all slices have met: now the size classes of a source meet
            open_units = open_units.withColumn("class", F.lit(0))
        folded = stored(_folded(open_units, unit, level, seed), f"mix-level-{level}")
        done.append(folded.select("source", F.explode("done").alias("unit")))
        open_units = folded.select("source", "class", "slice", F.col("carry").alias("unit"))
    # The root: one fraction per source, rounded to the nearer side.
    nearer = (F.col("unit.p") >= 0.5).cast("double")
    root = open_units.select("source", F.col("unit").withField("p", nearer).alias("unit"))
    decided = root
    for part in done:
        decided = decided.unionByName(part)
    rounded = decided.select("source", "unit.*").select(
        "key.*", "source", "size", "source_size", "target", "n", (F.col("whole") + F.round("p").cast("long")).alias("total")
    )
    rest = idle.select(
        "key.*", "source", "size", "source_size", "target", "n",
        F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("total"),
    )
    return rounded.unionByName(rest)


def _folded(open_units: DataFrame, unit: str, level: int, seed: int) -> DataFrame:
    def with_p(name: str, p: str) -> str:
        fields = "size key n whole source_size target".split()
        inner = ", ".join(f"'{f}', {name}.{f}" if f != "whole" else f"'p', {p}, '{f}', {name}.{f}" for f in fields)
        return f"cast(named_struct({inner}) AS {unit})"

    fold = _FOLD.format(
        unit=unit, level=level, seed=seed,
        x_all=with_p("a.carry", "(d.x_has + d.y_has) / a.carry.size"), x_1=with_p("a.carry", "1D"),
        x_less=with_p("a.carry", "(d.x_has - d.y_room) / a.carry.size"), x_0=with_p("a.carry", "0D"),
        y_all=with_p("y", "(d.x_has + d.y_has) / y.size"), y_1=with_p("y", "1D"),
        y_less=with_p("y", "(d.y_has - d.x_room) / y.size"), y_0=with_p("y", "0D"),
    )
    # A block has about BLOCK units (BLOCK residuals, or one per size class), whatever the table's size.
    blocks = open_units.groupBy("source", "class", "slice").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
    got = blocks.select(
        "source", "class", "slice", F.expr(fold).alias("got")
    )
    return got.select("source", "class", "slice", "got.carry", "got.done")


def mixed(docs: DataFrame, text: str = "text", seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (not at all: the row is gone).

    Rows alike in id, text and source share their copies: the first of them in no set order get one more.
    """
    from pyspark.sql import Window as W

    mark = F.xxhash64("doc_id", text)
    keyed = docs.withColumns({"__mark": mark, "__size": word_count(text)})
    sizes = keyed.select(F.col("doc_id"), F.col("__mark").alias("mark"), "source", F.col("__size").alias("size"))
    taken = copies(sizes, ["doc_id", "mark"], seed).where("total > 0").select(
        F.col("mark").alias("__m"), F.col("doc_id").alias("__id"), F.col("source").alias("__s"), F.col("n").alias("__n"),
        F.col("total").alias("__total"),
    )
    joined = keyed.join(
        taken,
        (F.col("__mark") == F.col("__m")) & F.col("doc_id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__s")),
    )
    single = joined.where("__n = 1").withColumn("__copies", F.col("__total"))
    place = F.row_number().over(W.partitionBy("__mark", "__id", "__s").orderBy("__size"))
    several = joined.where("__n > 1").withColumn(
        "__copies", F.expr("__total div __n") + F.when(place <= F.col("__total") % F.col("__n"), 1).otherwise(0)
    )
    rows = single.unionByName(several).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("size"))
    got = copies(stored(sizes, "mix-sizes"), ["doc_id"])
    each = got.withColumn("i", F.explode(F.expr("sequence(1L, n)")))
    own = F.expr("total div n") + F.when(F.col("i") <= F.col("total") % F.col("n"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"))

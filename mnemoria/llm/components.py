"""Classes of linked nodes, found in buckets without forming all their pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemoria.llm.common import stored
from mnemoria.scale import connected


def linked_classes(
    buckets: Callable[[], DataFrame],
    near: Callable[[Column, Column], Column],
    details: DataFrame | None = None,
    exact: Callable[[Column, Column], Column] | None = None,
    verify: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """(node, root) of all nodes that links join, looking for links in buckets but not at all their pairs.

    ``buckets()`` gives rows (bucket, node, payload); two nodes may be linked only if they share a bucket and ``near`` holds of
    their payloads. If payloads are only a part, ``details`` (node, detail) has the rest and ``exact`` tests it. Of the
    pairs (a, b) left, ``verify`` gives those that are links.

    First, each member of a bucket is tried against the bucket's smallest node, which joins dense groups. Then only members
    outside a bucket's largest class so far are tried against the members of other classes. Every link that could join
    two classes is tried, so the classes are exact, while a bucket of n nodes in one class costs n trials. Where there
    are details, they are fetched for rows with a near partner only, so that only what ``exact`` holds of becomes a row.
    """
    whole = W.partitionBy("bucket")
    hub = buckets().withColumn("hub", F.min(F.struct("node", "payload")).over(whole)).where("hub.node <> node")
    stars = hub.where(near(F.col("hub.payload"), F.col("payload"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    if details is not None:
        a, b = (details.select(F.col("node").alias(n), F.col("detail").alias(f"detail_{n}")) for n in "ab")
        stars = stars.join(a, "a").join(b, "b").where(exact(F.col("detail_a"), F.col("detail_b")))
    roots = connected(stored(verify(stars.select("a", "b")).select("a", "b"), "star-links"))

    joined = buckets().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = joined.withColumn("size", F.count("*").over(W.partitionBy("bucket", "root")))
    marked = marked.withColumn("main", F.max(F.struct("size", "root")).over(whole)["root"])
    mixed = marked.withColumn("others", F.min("root").over(whole) != F.max("root").over(whole)).where("others")
    left = mixed.where("root <> main").select("bucket", F.col("node").alias("a"), F.col("payload").alias("pa"), F.col("root").alias("ra"))
    right = mixed.select("bucket", F.col("node").alias("b"), F.col("payload").alias("pb"), F.col("root").alias("rb"))
    same = F.col("bucket") == F.col("bucket_b")
    apart = F.col("ra") != F.col("rb")
    other = right.withColumnRenamed("bucket", "bucket_b")
    if details is None:
        pairs = left.join(other, same & apart & near(F.col("pa"), F.col("pb")))
    else:
        some = near(F.col("pa"), F.col("pb"))
        l2 = stored(left.join(other, same & apart & some, "left_semi").drop("pa"), "near-left").join(a, "a")
        r2 = stored(other.join(left, same & apart & some, "left_semi").drop("pb"), "near-right").join(b, "b")
        pairs = l2.join(r2, same & apart & exact(F.col("detail_a"), F.col("detail_b")))
    links = verify(pairs.select("a", "b").distinct()).select("a", "b")
    of = roots.select("node", "root")
    named = links.join(of.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        of.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
    )
    cross = stored(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), "cross-links")
    if cross.isEmpty():
        return roots
    tops = connected(cross)
    # A root without star links is a node of its own.
    all_roots = roots.unionByName(
        tops.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti")
    )
    renamed = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(
        all_roots.join(renamed, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "classes"
    )


def classes_in_buckets(
    buckets: DataFrame,
    near: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame],
    enough: Callable[[Column, Column, Column], Column],
    often: int = 10,
) -> DataFrame:
    """(node, root) of all nodes that links join; ``buckets`` has rows (bucket, node, payload), each pair of them once.

    As ``linked_classes``, but a bucket is never brought together to be looked over: its ends, its classes and their sizes come
    from partial sums, and only buckets of two nodes or more are written and read again. ``near`` is a cheap test of payloads, the
    sizes of sets; of the pairs (a, b) that pass it, ``verify`` gives those that are links. In pairs with a bucket's smallest
    node, that is ``a``. Other pairs are those of ``pairs_across``.
    """
    ends = buckets.groupBy("bucket").agg(F.min(F.struct("node", "payload")).alias("hub"), F.max("node").alias("top"))
    shared = stored(buckets.join(ends.where("hub.node < top").drop("top"), "bucket"), "shared-buckets")
    met = shared.where(F.col("node") != F.col("hub.node")).where(near(F.col("hub.payload"), F.col("payload")))
    stars = met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    roots = connected(stored(verify(stars).select("a", "b"), "star-links"))

    placed = shared.drop("hub").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("classes"))
    mixed = stored(placed.join(mains.where("classes > 1").drop("classes"), "bucket"), "mixed-buckets")
    links = stored(verify(pairs_across(mixed, near, elements, enough, often)).select("a", "b"), "cross-pairs")
    if links.isEmpty():
        return roots
    tops = connected(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return tops


def pairs_across(
    mixed: DataFrame,
    near: Callable[[Column, Column], Column],
    elements: Callable[[DataFrame], DataFrame],
    enough: Callable[[Column, Column, Column], Column],
    often: int,
) -> DataFrame:
    """Pairs (a, b) of unlike classes in ``mixed`` (bucket, node, payload, root, main) that may be links.

    ``elements`` gives rows (node, element) of the sets of nodes, and ``enough(n, a, b)`` tells whether sets of sizes a and b
    that share n elements may be linked. Two sets share no more than the lesser number of their frequent elements, those in over
    ``often`` sets, and their common rare ones. Pairs that share a rare element are found by it, which makes at most ``often``
    rows an element. Others are linked only if frequent elements alone are enough, which leaves out, before any pair is formed,
    sets whose own changes are too many: a group of n such sets does not cost n * n trials.
    """
    members = mixed.select("node", "root", "payload").distinct()
    held = elements(members.select("node"))
    rare = held.groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") <= often)
    rarely = stored(held.join(rare, "element"), "rare-elements")
    own = rarely.groupBy("node").agg(F.count("*").alias("rare"))
    known = stored(
        members.join(own, "node", "left").withColumn("often", F.col("payload") - F.coalesce("rare", F.lit(0))).drop("rare"), "members"
    )

    met = rarely.where("n > 1").join(known, "node").select("element", "node", "root", "payload", "often")
    x, y = (met.select("element", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "payload", "often")]) for s in "ab")
    both = x.join(y, "element").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")))
    both = both.where(near(F.col("payload_a"), F.col("payload_b")))
    by_rare = both.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count("*").alias("rare"), *[F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in ("payload", "often") for s in "ab"]
    ).where(enough(F.col("rare") + F.least("often_a", "often_b"), F.col("payload_a"), F.col("payload_b")))

    # A set can be linked by frequent elements alone only if they are enough for a set that has nothing else.
    able = known.where(enough(F.col("often"), F.col("payload"), F.col("often"))).select("node", "often")
    tried = mixed.join(able, "node")
    left = tried.where("root <> main").select(
        "bucket", F.col("node").alias("a"), F.col("payload").alias("pa"), F.col("root").alias("ra"), F.col("often").alias("oa")
    )
    right = tried.select(
        "bucket", F.col("node").alias("b"), F.col("payload").alias("pb"), F.col("root").alias("rb"), F.col("often").alias("ob"), "main"
    )
    # Between two classes of which neither is the main one, each pair is tried once.
    once = (F.col("rb") == F.col("main")) | (F.col("ra") < F.col("rb"))
    by_often = left.join(right, "bucket").where(
        (F.col("ra") != F.col("rb")) & once & near(F.col("pa"), F.col("pb")) & enough(F.least("oa", "ob"), F.col("pa"), F.col("pb"))
    )
    return by_often.select("a", "b").unionByName(by_rare.select("a", "b")).distinct()

"""Agglomerative clustering by reciprocal nearest neighbours: each round merges all pairs of clusters that are nearest to each
other, and the distances between the merged ones are one grouped sum. Single, complete and average linkage never bring clusters
closer than those just merged, so all rounds together are the tree that merging one pair at a time gives. The pairs are a table of n^2/2 rows that shrinks
with every round; no task holds a matrix. Of equal distances the pair with the lesser names comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import clean, global_row_number, materialized

LINKAGES = ("single", "complete", "average")


def distances(cells: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """a, b, d: Euclidean distances of all pairs of samples, a before b. Missing cells take their feature's mean; a
    feature without values is left out. Cells that are no rows at all count as missing too."""
    t = cells.select(F.col(sample).alias("s"), F.col(feature).alias("f"), clean(value).alias("v")).dropna(subset=["s", "f"]).groupBy("s", "f").agg(F.avg("v").alias("v"))
    means = t.groupBy("f").agg(F.avg("v").alias("m")).where("m is not null")
    t = materialized(t.join(means, "f").select("s", "f", (F.coalesce("v", "m") - F.col("m")).alias("v")))
    # centred by feature, an absent cell is zero: |x - y|^2 = |x|^2 + |y|^2 - 2 x.y over the cells that both have
    norms = cells.select(F.col(sample).alias("s")).dropna().distinct().join(t.groupBy("s").agg(F.sum(F.col("v") * F.col("v")).alias("n")), "s", "left").na.fill(0.0, ["n"])
    norms = materialized(norms)
    x, y = t.select(F.col("s").alias("a"), "f", F.col("v").alias("x")), t.select(F.col("s").alias("b"), "f", F.col("v").alias("y"))
    near = x.join(y, "f").where("a < b").groupBy("a", "b").agg(F.sum((F.col("x") - F.col("y")) ** 2 - F.col("x") ** 2 - F.col("y") ** 2).alias("c"))
    every = norms.select(F.col("s").alias("a"), F.col("n").alias("na")).join(norms.select(F.col("s").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))  # the outcome is all pairs
    return every.join(near, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(F.col("na") + F.col("nb") + F.coalesce("c", F.lit(0.0)), F.lit(0.0))).alias("d"))


def linkage(pairs: DataFrame, how: str = "average") -> DataFrame:
    """left, right (the least members of both clusters, left before right), height, size, step (from 1, by height): n - 1
    merges of the n labels in `pairs` (a, b, d, each pair once). The merged cluster goes on under the name left."""
    if how not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialized(pairs.select(low.alias("a"), high.alias("b"), clean("d").alias("d")).where("a <> b").withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")}))
    rounds = []
    while not now.isEmpty():
        way = F.struct("d", "a", "b")
        ends = now.select(F.col("a").alias("s"), way.alias("w")).union(now.select(F.col("b").alias("s"), way.alias("w"))).groupBy("s").agg(F.min("w").alias("w"))
        both = ends.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("w.a", "w.b")
        merges = materialized(both.join(now, ["a", "b"]).select("a", "b", "d", (F.col("na") + F.col("nb")).alias("size")))
        rounds.append(merges)
        name = merges.select(F.col("b").alias("old"), F.col("a").alias("new"), "size").union(merges.select(F.col("a"), F.col("a"), "size"))
        side = lambda c: name.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}"), F.col("size").alias(f"size_{c}"))
        t = now.join(side("a"), "a", "left").join(side("b"), "b", "left")
        p, q = F.coalesce("new_a", "a"), F.coalesce("new_b", "b")
        np_, nq = F.coalesce("size_a", "na"), F.coalesce("size_b", "nb")
        swap = p > q
        w = F.col("na") * F.col("nb")
        of = {"single": F.min("d"), "complete": F.max("d"), "average": F.sum(F.col("d") * w) / F.sum(w)}[how]
        t = t.where(p != q).groupBy(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.when(swap, nq).otherwise(np_).alias("na"), F.when(swap, np_).otherwise(nq).alias("nb")).agg(of.alias("d"))
        now = materialized(t.select("a", "b", "d", "na", "nb"))
    if not rounds:
        return pairs.select(F.col("a").alias("left"), F.col("b").alias("right"), F.lit(0.0).alias("height"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("step"), F.lit(0).alias("round")).where("false")
    out = rounds[0].withColumn("round", F.lit(0))
    for k, more in enumerate(rounds[1:], 1):
        out = out.union(more.withColumn("round", F.lit(k)))
    return materialized(global_row_number(out, "d", "round", "a", "b", name="step").select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), "size", "step", "round"))


def cut(merges: DataFrame, labels: DataFrame, label: str, clusters: int) -> DataFrame:
    """label and cluster, numbered from 0 by their least members, after all but the last clusters - 1 merges."""
    n = merges.agg(F.max("step"), F.max("round")).first()
    out = labels.select(F.col(label).alias("_l")).dropna().distinct().withColumn("_c", F.col("_l"))
    if n[0] is not None:
        kept = merges.where(F.col("step") <= n[0] + 1 - clusters)
        for k in range(n[1] + 1):
            out = out.join(kept.where(F.col("round") == k).select(F.col("right").alias("_c"), F.col("left").alias("_new")), "_c", "left").select("_l", F.coalesce("_new", "_c").alias("_c"))
    out = materialized(out)
    names = global_row_number(out.select("_c").distinct(), "_c", name="_n").select("_c", (F.col("_n") - 1).cast("int").alias("cluster"))  # a row for each cluster
    return out.join(names, "_c").select(F.col("_l").alias(label), "cluster")


def hierarchical_clustering(cells: DataFrame, sample: str, feature: str, value: str, clusters: int, how: str = "average") -> DataFrame:
    """sample and its cluster (from 0, by the least members), of a tree on Euclidean distances."""
    d = materialized(distances(cells, sample, feature, value))
    return cut(linkage(d, how), cells, sample, clusters)


def upgma(pairs: DataFrame) -> DataFrame:
    """The average-linkage tree of given distances (a, b, d) as rows node, parent, length, is_leaf: a node's height is half
    the distance at which it merged, a branch the difference of heights. Inner nodes are `node<step>`; the last has no parent."""
    m = materialized(linkage(pairs, "average"))
    name = F.concat(F.lit("node"), F.col("step").cast("string"))
    # a cluster is known by its least member; the merge that it enters follows the one that made it
    ends = m.select(F.col("left").alias("c"), "step", name.alias("node"), "height").union(m.select(F.col("right").alias("c"), "step", name.alias("node"), "height"))
    entered = ends.withColumn("made", F.lag(F.struct("node", "height")).over(Window.partitionBy("c").orderBy("step")))  # merges that a name goes through: the depth of the tree
    rows = entered.select(F.coalesce("made.node", F.col("c").cast("string")).alias("node"), F.col("node").alias("parent"), ((F.col("height") - F.coalesce("made.height", F.lit(0.0))) / 2).alias("length"), F.col("made").isNull().alias("is_leaf"))
    root = m.orderBy(F.desc("step")).limit(1).select(name.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("length"), F.lit(False).alias("is_leaf"))
    return rows.union(root)

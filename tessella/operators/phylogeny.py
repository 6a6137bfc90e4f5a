"""Diversity on a tree, given as rows (node, parent, length). Abundances are carried from the tips to all nodes above them
edge by edge; pairs of samples are compared in blocks of samples and nodes of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean, global_row_number, materialized
from tessella.operators.ontology import closure
from tessella.session import ship

_SAMPLES, _NODES = 128, 2048


def _tips(cells: DataFrame, tree: DataFrame, sample: str, taxon: str, count: str, node: str = "node", parent: str = "parent", length: str = "length") -> tuple[DataFrame, DataFrame]:
    """sample, node, count, seen (whether any of its counts is above 0) for the taxa of each sample, and the tree as node,
    parent, length: both written once. Taxa that are no node of the tree raise an error."""
    tree = materialized(tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"), clean(length).alias("length")))
    known = tree.select(F.col("node").alias("_n")).union(tree.select(F.col("parent").alias("_n"))).dropna().distinct()
    t = cells.select(F.col(sample).alias("sample"), F.col(taxon).alias("node"), F.coalesce(clean(count), F.lit(0.0)).alias("c")).where("sample is not null and node is not null").groupBy("sample", "node").agg(F.sum("c").alias("count"), F.max(F.col("c") > 0).alias("seen"))
    t = t.join(known, F.col("node") == F.col("_n"), "left").withColumn("node", F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no tip of the tree: "), F.col("node").cast("string"))).cast(dict(t.dtypes)["node"])).otherwise(F.col("node"))).drop("_n")
    return materialized(t), tree


def _ends(edges: DataFrame) -> bool:
    """Whether all ways up end: steps of doubled length run out before they are longer than there are edges."""
    step, far, most = edges.where("node <> parent").select("node", "parent"), 1, edges.count()
    while far <= most and not step.isEmpty():
        on = step.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        step, far = materialized(step.join(on, "parent").select("node", F.col("top").alias("parent"))), 2 * far
    return far <= most or step.isEmpty()


def _above(tips: DataFrame, tree: DataFrame, unsure: int = 64) -> DataFrame:
    """sample, node, length, count: the sums of all tips at or below each node. Sums go up an edge a round and are added up
    there, so a level of the tree costs its nodes and not its tips. A graph in which a node has two rows, or ways that never
    end (asked after `unsure` rounds), goes by its closure."""
    edges = tree.where("node is not null and parent is not null")

    def by_closure() -> DataFrame:
        up = closure(tree, "node", "parent").withColumnRenamed("term", "node")
        sums = tips.join(up, "node").groupBy("sample", F.col("ancestor").alias("node")).agg(F.sum("count").alias("count"))
        return sums.join(edges.select("node", "length"), "node", "left").select("sample", "node", F.coalesce("length", F.lit(0.0)).alias("length"), "count")

    def together(found: list[DataFrame]) -> DataFrame:
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.groupBy("sample", "node").agg(F.max("length").alias("length"), F.sum("count").alias("count"))  # a node has one length

    if not edges.groupBy("node").count().where("count > 1").isEmpty():
        return by_closure()
    now, found, rounds = tips.select("sample", "node", "count"), [], 0
    while True:
        here = materialized(now.join(edges, "node", "left").select("sample", "node", F.coalesce("length", F.lit(0.0)).alias("length"), "count", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent")))
        found.append(here.drop("parent"))
        if len(found) > 12:  # one table of what is found, so that the union stays short
            found = [materialized(together(found))]
        on, rounds = here.where("parent is not null"), rounds + 1
        if on.isEmpty():
            return together(found)
        if rounds == unsure and not _ends(edges):
            return by_closure()
        now = on.groupBy("sample", F.col("parent").alias("node")).agg(F.sum("count").alias("count"))


def node_counts(cells: DataFrame, tree: DataFrame, sample: str, taxon: str, count: str, **names: str) -> DataFrame:
    """sample, node, length, count and the sample's total: counts of all tips at or below each node. Missing counts are 0;
    the root's length counts as 0. A sample without counts has one row without a node."""
    tips, tree = _tips(cells, tree, sample, taxon, count, **names)
    totals = materialized(tips.groupBy("sample").agg(F.sum("count").alias("total"), F.max(F.col("count") > 0).alias("_some")))
    by_node = _above(tips.where("count > 0"), tree)
    rows = by_node.join(totals.where("_some"), "sample").select("sample", "node", "length", "count", "total")
    none = totals.where("not _some").select("sample", F.lit(None).cast(dict(rows.dtypes)["node"]).alias("node"), F.lit(0.0).alias("length"), F.lit(0.0).alias("count"), "total")
    return rows.unionByName(none)


def faith_pd(cells: DataFrame, tree: DataFrame, sample: str, taxon: str, count: str, **names: str) -> DataFrame:
    """sample, pd (the length of all branches above its taxa), n_taxa_observed. A sample without counts has 0."""
    tips, tree = _tips(cells, tree, sample, taxon, count, **names)
    pd = _above(tips.where("count > 0"), tree).groupBy("sample").agg(F.sum("length").alias("pd"))
    seen = tips.groupBy("sample").agg(F.count_if("seen").alias("n_taxa_observed"))
    return seen.join(pd, "sample", "left").select("sample", F.coalesce("pd", F.lit(0.0)).alias("pd"), "n_taxa_observed")


def unifrac(cells: DataFrame, tree: DataFrame, sample: str, taxon: str, count: str, weighted: bool = False, **names: str) -> DataFrame:
    """a, b, distance for all pairs of samples, a before b. Unweighted: length of the branches that one of both has, over
    the length of those that either has (0 if none). Weighted: the sum of length x |difference of shares|."""
    ship(cells.sparkSession)
    t = materialized(node_counts(cells, tree, sample, taxon, count, **names))
    samples = materialized(global_row_number(t.select("sample").distinct(), "sample", name="at"))
    many = samples.count()
    blocks = -(-many // _SAMPLES)
    # a sample meets its own block and those of all others: (block, other) with the lesser first
    rows = t.join(samples, "sample").where("count > 0").select((F.col("at") - 1).alias("at"), F.pmod(F.xxhash64("node"), F.lit(1 << 40)).alias("h"), "node", "length", (F.col("count") / F.col("total")).alias("share"))
    spread = max(1, -(-t.agg(F.approx_count_distinct("node")).first()[0] // _NODES))
    mine = F.floor(F.col("at") / _SAMPLES).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))))
    rows = rows.select(F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("h") % spread).cast("int").alias("r"), "at", "node", "length", "share")

    def compare(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        at, named = group["at"].to_numpy(), group["node"].combine_chunks().dictionary_encode("encode")
        code = named.indices.to_numpy()
        long = np.zeros(len(named.dictionary))
        long[code] = group["length"].to_numpy()
        share = group["share"].to_numpy()
        sides = []
        for block in (p, q):
            x = np.zeros((min(_SAMPLES, many - block * _SAMPLES), len(long)))
            here = at // _SAMPLES == block
            x[at[here] - block * _SAMPLES, code[here]] = share[here]
            sides.append(x)
        a, b = sides
        if weighted:
            top = np.stack([(long * np.abs(v - b)).sum(axis=1) for v in a])
            base = np.zeros_like(top)
        else:
            has_a, has_b = (a > 0).astype(float), (b > 0).astype(float)
            shared = (has_a * long) @ has_b.T
            base = (has_a @ long)[:, None] + (has_b @ long)[None, :] - shared
            top = base - shared
        return pa.table({"p": [p], "q": [q], "top": pa.array([top.tobytes()], pa.binary()), "base": pa.array([base.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        shape = tuple(min(_SAMPLES, many - k * _SAMPLES) for k in (p, q))
        top, base = (sum(np.frombuffer(b.as_py()) for b in group[c]).reshape(shape) for c in ("top", "base"))
        value = top if weighted else np.divide(top, base, out=np.zeros(shape), where=base > 0)
        i, j = (x.ravel() for x in np.indices(shape))
        i, j = i + p * _SAMPLES, j + q * _SAMPLES
        keep = i < j
        return pa.table({"i": i[keep], "j": j[keep], "distance": value.ravel()[keep]})

    # every pair of blocks has an outcome, also where no sample in them has counts
    spark = cells.sparkSession
    zero = spark.range(blocks).select(F.col("id").cast("int").alias("p")).withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(blocks - 1)))) if blocks else None
    if zero is None:
        return t.select(F.col("sample").alias("a"), F.col("sample").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    like = dict(rows.dtypes)
    rows = rows.unionByName(zero.select("p", "q", F.lit(0).alias("r"), (F.col("p") * F.lit(_SAMPLES)).cast("long").alias("at"), F.lit(None).cast(like["node"]).alias("node"), F.lit(0.0).alias("length"), F.lit(0.0).alias("share")))
    sums = rows.groupBy("p", "q", "r").applyInArrow(compare, "p long, q long, top binary, base binary")
    found = sums.groupBy("p", "q").applyInArrow(add, "i long, j long, distance double")
    name = lambda n, k: samples.select((F.col("at") - 1).alias(k), F.col("sample").alias(n))
    return found.join(name("a", "i"), "i").join(name("b", "j"), "j").select("a", "b", "distance")

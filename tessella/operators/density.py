"""Clustering by density: boxes so small that their points are all neighbours stand for them."""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import global_row_number, materialized


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b, of any type that has an order. node and root (the least node of its component), for nodes on edges.
    Every node takes its neighbours to the least of them, the larger ones first, then the smaller ones, until nothing
    changes: about as many rounds as the logarithm of the nodes."""
    e = materialized(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = materialized(large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct())


def _squares(a: str, b: str, dims: int) -> tuple[Column, Column]:
    """Squared least and largest distance of the boxes of two aliases (lo and hi, arrays)."""
    at = lambda side, name, i: F.col(f"{side}.{name}")[i]
    gap = lambda i: F.greatest(F.lit(0.0), at(a, "lo", i) - at(b, "hi", i), at(b, "lo", i) - at(a, "hi", i))
    span = lambda i: F.greatest(at(a, "hi", i) - at(b, "lo", i), at(b, "hi", i) - at(a, "lo", i))
    return reduce(add, [gap(i) * gap(i) for i in range(dims)]), reduce(add, [span(i) * span(i) for i in range(dims)])


def _square(a: str, b: str, dims: int) -> Column:
    d = [F.col(a)[i] - F.col(b)[i] for i in range(dims)]
    return reduce(add, [x * x for x in d])


def _boxes(points: DataFrame, dims: int, *keys: str) -> DataFrame:
    """Tight bounds and sizes of the points by `keys`: lo, hi, n (rows) and k (distinct points)."""
    ends = [F.array(*[f(F.col("x")[i]) for i in range(dims)]).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    return points.groupBy(*keys).agg(*ends, F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))


def _near(left: DataFrame, right: DataFrame, eps: float, dims: int) -> DataFrame:
    """Pairs of boxes that lie within eps of each other: cell a, cell b, far (the square of their largest distance), pairs
    (of points). An equi-join on squares of side eps over the first two dimensions."""
    grid = range(min(dims, 2))
    square = lambda i: F.floor(F.col("lo")[i] / eps)
    moves = F.array(*[F.array(*[F.lit(m) for m in move]) for move in itertools.product(range(-2, 3), repeat=len(grid))])
    a = left.withColumn("_m", F.explode(moves)).withColumns({f"s{i}": square(i) + F.col("_m")[i] for i in grid}).alias("a")
    b = right.withColumns({f"s{i}": square(i) for i in grid}).alias("b")
    close, far = _squares("a", "b", dims)
    pairs = a.join(b, [F.col(f"a.s{i}") == F.col(f"b.s{i}") for i in grid]).where(close <= eps * eps)
    return pairs.select(F.col("a.cell").alias("a"), F.col("b.cell").alias("b"), far.alias("far"), (F.col("a.k") * F.col("b.k")).alias("pairs"))


def _linked(core: DataFrame, eps: float, side: float, dims: int, budget: int | None, deepest: int = 16) -> DataFrame:
    """Pairs of cells (a, b) with two core points within eps. Pairs of boxes that are neither all within nor all beyond it
    are halved, with the pairs whose cells are linked left out, until few pairs of points are left; those are compared."""
    boxes = materialized(_boxes(core, dims, "cell"))
    if budget is None:
        budget = max(1 << 20, 4 * (boxes.agg(F.sum("k")).first()[0] or 0))
    pairs = materialized(_near(boxes, boxes, eps, dims).where("a < b").withColumns({"sa": F.col("a"), "sb": F.col("b")}))
    found, level = [], 0
    while True:
        sure = pairs.where(F.col("far") <= eps * eps).select("a", "b").distinct()
        found.append(sure)
        open_pairs = materialized(pairs.join(sure, ["a", "b"], "left_anti"))
        left = open_pairs.agg(F.sum("pairs")).first()[0] or 0
        halves = F.transform("x", lambda v: F.floor(v * (1 << level) / side))  # noqa: B023
        if left <= budget or level == deepest:
            p = core.withColumn("sub", halves)
            p, q = p.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("x").alias("p")), p.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("x").alias("q"))
            if left:
                found.append(open_pairs.select("a", "b", "sa", "sb").join(p, ["a", "sa"]).join(q, ["b", "sb"]).where(_square("p", "q", dims) <= eps * eps).select("a", "b").distinct())
            return reduce(DataFrame.union, found)
        level += 1
        halves = F.transform("x", lambda v: F.floor(v * (1 << level) / side))  # noqa: B023
        live = open_pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        sub = materialized(_boxes(core.join(live, "cell").withColumn("sub", halves), dims, "cell", "sub").withColumn("up", F.transform("sub", lambda v: F.floor(v / 2))))
        o, a, b = open_pairs.select("a", "b", "sa", "sb").alias("o"), sub.alias("a"), sub.alias("b")
        both = o.join(a, (F.col("o.a") == F.col("a.cell")) & (F.col("o.sa") == F.col("a.up"))).join(b, (F.col("o.b") == F.col("b.cell")) & (F.col("o.sb") == F.col("b.up")))
        close, far = _squares("a", "b", dims)
        pairs = materialized(both.where(close <= eps * eps).select("o.a", "o.b", far.alias("far"), (F.col("a.k") * F.col("b.k")).alias("pairs"), F.col("a.sub").alias("sa"), F.col("b.sub").alias("sb")))


def dbscan(rows: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5, budget: int | None = None) -> DataFrame:
    """key, cluster (int, from 0 by the least key of a cluster's core points; -1: noise) and core, for every row; Euclidean.

    A core point has at least `min_samples` rows within eps, itself included; core points within eps of each other share a
    cluster; another point within eps of core points takes the lowest of their clusters. Equal vectors are one point with a
    weight. Points live in cells of side eps / sqrt(dimensions), whose points are all neighbours: a cell of `min_samples`
    rows holds core points only and is one node, so pairs of points are looked at only from thinner cells and, for links of
    cells, where boxes cannot tell (`budget` pairs at most, by default four for each point, before boxes are halved).

    Vectors that are null, hold null or non-finite entries or are shorter than the longest have no cluster (null) and are
    not core. Keys may repeat. Other columns are not returned.
    """
    if eps <= 0 or min_samples < 2:
        raise ValueError("eps must be above 0 and min_samples at least 2")
    base = rows.select(F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double") + 0.0).alias("x"))
    fine = F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    base = base.withColumn("x", F.when(F.coalesce(fine, F.lit(False)), F.col("x")))
    dims = base.agg(F.max(F.size("x"))).first()[0] or 0
    name = key
    if dims < 1:
        return base.select(F.col("key").alias(name), F.lit(None).cast("int").alias("cluster"), F.lit(False).alias("core"))
    base = base.withColumn("x", F.when(F.size("x") == dims, F.col("x")))
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    points = base.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    points = materialized(points.withColumn("cell", F.transform("x", lambda v: F.floor(v / side))))
    cells = materialized(_boxes(points, dims, "cell"))
    thin = cells.where(F.col("n") < min_samples)
    near = materialized(_near(thin, cells, eps, dims).select(F.col("a").alias("cell"), "b"))
    around = points.join(thin.select("cell"), "cell").join(near, "cell").select("x", "b")
    met = around.join(points.select(F.col("x").alias("y"), F.col("cell").alias("b"), F.col("n").alias("m")), "b").where(_square("x", "y", dims) <= eps * eps)
    many = met.groupBy("x").agg(F.sum("m").alias("m"))
    core = points.join(cells.select("cell", F.col("n").alias("held")), "cell").join(many, "x", "left").withColumn("core", (F.col("held") >= min_samples) | (F.coalesce("m", F.lit(0)) >= min_samples))
    points = materialized(core.select("x", "n", "first", "cell", "core"))
    core = points.where("core")
    roots = components(_linked(core, eps, side, dims, budget)).withColumnRenamed("node", "cell")
    rooted = materialized(core.select("cell", "first").groupBy("cell").agg(F.min("first").alias("first")).join(roots, "cell", "left").select("cell", F.coalesce("root", "cell").alias("root"), "first"))
    numbers = global_row_number(rooted.groupBy("root").agg(F.min("first").alias("first")).withColumn("tie", F.col("root").cast("string")), "first", "tie", name="k").select("root", (F.col("k") - 1).cast("int").alias("cluster"))
    named = materialized(rooted.join(numbers, "root").select("cell", "cluster"))
    edge = points.where("not core").join(near, "cell").select("x", "b")
    reached = edge.join(core.select(F.col("x").alias("y"), F.col("cell").alias("b")), "b").where(_square("x", "y", dims) <= eps * eps).join(named.withColumnRenamed("cell", "b"), "b").groupBy("x").agg(F.min("cluster").alias("border"))
    told = points.join(named, "cell", "left").join(reached, "x", "left").select("x", "core", F.when(F.col("core"), F.col("cluster")).otherwise(F.coalesce("border", F.lit(-1))).alias("cluster"))
    return base.join(told, "x", "left").select(F.col("key").alias(name), "cluster", F.coalesce("core", F.lit(False)).alias("core"))

"""All pairs of an axis by a join on the other axis. The result has n² / 2 rows by nature; `max_positions`, if given, refuses more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean


def _checked(cells: DataFrame, dim: str, most: int | None) -> None:
    if most is not None and cells.select(dim).distinct().count() > most:
        raise ValueError(f"more than {most} positions on {dim}")


def distance_matrix(cells: DataFrame, dim: str, feature: str, value: str = "value", metric: str = "euclidean", max_positions: int | None = None) -> DataFrame:
    """Pairs (a < b) and their distance; missing counts as 0. Only features that one of the two has are joined: sums over
    single positions give the rest, so sparse rows stay sparse."""
    _checked(cells, dim, max_positions)
    v = F.coalesce(clean(value), F.lit(0.0))
    t = cells.select(F.col(dim).alias("p"), F.col(feature).alias("f"), v.alias("v")).where("v <> 0")
    one = t.groupBy("p").agg(F.sum("v").alias("s"), F.sum(F.abs("v")).alias("l1"), F.sum(F.col("v") ** 2).alias("l2"), F.count(F.lit(1)).alias("k"))
    every = cells.select(F.col(dim).alias("p")).distinct().join(one, "p", "left").na.fill(0)
    a, b = F.col("a.v"), F.col("b.v")
    both = t.alias("a").join(t.alias("b"), (F.col("a.f") == F.col("b.f")) & (F.col("a.p") < F.col("b.p")))
    both = both.groupBy(F.col("a.p").alias("a"), F.col("b.p").alias("b")).agg(F.sum(a * b).alias("dot"), F.sum(F.abs(a - b) - F.abs(a) - F.abs(b)).alias("d1"), F.sum(F.least(a, b)).alias("low"), F.count(F.lit(1)).alias("common"))
    x, y = every.select(*[F.col(c).alias(f"{c}_a") for c in every.columns]), every.select(*[F.col(c).alias(f"{c}_b") for c in every.columns])
    pairs = x.join(y, F.col("p_a") < F.col("p_b")).join(both, (F.col("p_a") == F.col("a")) & (F.col("p_b") == F.col("b")), "left").na.fill(0, ["dot", "d1", "low", "common"])
    n2 = F.col("l2_a") + F.col("l2_b") - 2 * F.col("dot")
    d = {
        "euclidean": F.sqrt(F.greatest(n2, F.lit(0.0))),
        "manhattan": F.col("l1_a") + F.col("l1_b") + F.col("d1"),
        "cosine": F.when((F.col("l2_a") > 0) & (F.col("l2_b") > 0), 1 - F.col("dot") / F.sqrt(F.col("l2_a") * F.col("l2_b"))),
        "braycurtis": (F.col("l1_a") + F.col("l1_b") + F.col("d1")) / (F.col("s_a") + F.col("s_b")),
        "jaccard": F.when(F.col("k_a") + F.col("k_b") > 0, 1 - F.col("common") / (F.col("k_a") + F.col("k_b") - F.col("common"))).otherwise(0.0),
    }[metric]
    return pairs.select(F.col("p_a").alias("a"), F.col("p_b").alias("b"), d.alias("distance"))


def correlation(cells: DataFrame, dim: str, feature: str, value: str = "value", metric: str = "pearson", min_valid: int = 3, max_positions: int | None = None) -> DataFrame:
    """Pairs (a < b) over the features that both have; missing with fewer than min_valid or without spread. spearman ranks
    within each pair, over those features."""
    _checked(cells, dim, max_positions)
    t = cells.select(F.col(dim).alias("p"), F.col(feature).alias("f"), clean(value).alias("v")).where("v is not null")
    both = t.alias("a").join(t.alias("b"), (F.col("a.f") == F.col("b.f")) & (F.col("a.p") < F.col("b.p")))
    if metric == "spearman":
        return _rank_correlation(both.select(F.col("a.p").alias("a"), F.col("b.p").alias("b"), F.col("a.v").alias("x"), F.col("b.v").alias("y")), min_valid)
    g = both.groupBy(F.col("a.p").alias("a"), F.col("b.p").alias("b"))
    if metric == "cosine":
        r = F.sum(F.col("a.v") * F.col("b.v")) / F.sqrt(F.sum(F.col("a.v") ** 2) * F.sum(F.col("b.v") ** 2))
    else:
        r = F.when((F.var_pop("a.v") > 0) & (F.var_pop("b.v") > 0), F.corr("a.v", "b.v"))
    return g.agg(F.when(F.count(F.lit(1)) >= min_valid, r).alias("r"), F.count(F.lit(1)).alias("n"))


def _rank_correlation(pairs: DataFrame, min_valid: int) -> DataFrame:
    """Pearson's coefficient of average ranks for each (a, b), from counts of equal values (x, y)."""
    from tessella.operators.groups import _ranked

    keys = ["a", "b"]
    t = pairs.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    for name in ("x", "y"):
        ranks = _ranked(pairs, keys, name).select(*keys, F.col("_v").alias(name), F.col("_rank").cast("double").alias(f"r{name}"))
        t = t.join(ranks, [*keys, name])
    c, x, y = F.col("c"), F.col("rx"), F.col("ry")
    s = t.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"))
    mid = F.col("n") * (F.col("n") + 1.0) ** 2 / 4
    r = (F.col("xy") - mid) / F.sqrt((F.col("xx") - mid) * (F.col("yy") - mid))
    return s.select(*keys, F.when((F.col("n") >= min_valid) & (F.col("xx") > mid) & (F.col("yy") > mid), r).alias("r"), "n")

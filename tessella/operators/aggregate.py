"""Aggregation of cells: by group, along an axis, into bins; imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean, null_safe_join, over, quantiles


def _how(method: str, v: Column) -> Column:
    return {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count(v)}[method]


def median(rows: DataFrame, keys: list[str], value: Column | str, name: str) -> DataFrame:
    """keys and the exact median of each group, however large; a group without values keeps its row."""
    found = quantiles(rows, keys, value, [0.5], "_q").withColumn(name, F.col("_q")[0]).drop("_q")
    return null_safe_join(rows.select(*keys).distinct(), found, keys, "left") if keys else found


def aggregate(cells: DataFrame, groups: DataFrame, dim: str, group: str, other: str, value: str = "value", method: str = "sum") -> DataFrame:
    """Cells by group of their label; missing cells are left out, a group with none has sum 0 and no other statistic."""
    rows = cells.join(groups.select(dim, group), dim)
    return median(rows, [group, other], value, "value") if method == "median" else rows.groupBy(group, other).agg(_how(method, clean(value)).alias("value"))


def pseudobulk(cells: DataFrame, groups: DataFrame, cell: str, gene: str, group: str, value: str = "value", method: str = "sum") -> DataFrame:
    return aggregate(cells, groups, cell, group, gene, value, method)


def reduce_axis(cells: DataFrame, keep: list[str], value: str = "value", stats: tuple[str, ...] = ("sum", "mean", "std", "var", "min", "max", "median", "nonzero", "count")) -> DataFrame:
    """Statistics over all axes but `keep`, one column each; std and var are of the population."""
    v = clean(value)
    of = {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "std": F.stddev_pop(v), "var": F.var_pop(v), "min": F.min(v), "max": F.max(v), "nonzero": F.count_if(v != 0), "count": F.count(v)}
    plain = cells.groupBy(*keep).agg(*[of[s].alias(s) for s in stats if s != "median"], F.lit(1).alias("_one"))
    if "median" in stats:
        mid = median(cells, keep, value, "median")
        plain = null_safe_join(plain, mid, keep) if keep else plain.crossJoin(F.broadcast(mid))  # one row
    return plain.select(*keep, *stats)


def describe(cells: DataFrame, value: str = "value") -> DataFrame:
    v = clean(value)
    return cells.agg(F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def bin_values(rows: DataFrame, value: str, bins: int = 10, method: str = "quantile", name: str = "bin") -> DataFrame:
    """Adds the bin of each value: how many inner edges are at or below it; missing is -1. Edges are exact quantiles by
    linear interpolation, or equal widths (also if quantiles coincide)."""
    v = clean(value)
    if method == "quantile":
        low, *inner, high = quantiles(rows, [], v, [k / bins for k in range(bins + 1)]).first()["q"]
    else:
        low, high = rows.agg(F.min(v), F.max(v)).first()
        inner = []
    if low is not None and (method != "quantile" or len(set([low, *inner, high])) < bins + 1):
        inner = [low + (high - low) * k / bins for k in range(1, bins)]
    below = sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return rows.withColumn(name, F.when(v.isNull(), -1).otherwise(below).cast("int"))


def impute(cells: DataFrame, dim: str, value: str = "value", method: str = "median", min_scale: float = 1.0) -> DataFrame:
    """Fills missing cells: median or mean of the label (of the whole table where a label has none), or the table's minimum times min_scale."""
    v = clean(value)
    if method == "min":
        whole = cells.agg((F.min(v) * min_scale).alias("_all"))
        return cells.crossJoin(F.broadcast(whole)).withColumn(value, F.coalesce(v, "_all")).drop("_all")  # one row
    if method == "median":
        whole, own = median(cells, [], value, "_all"), median(cells, [dim], value, "_own")
    else:
        whole, own = cells.agg(F.avg(v).alias("_all")), cells.groupBy(dim).agg(F.avg(v).alias("_own"))
    return cells.join(own, dim, "left").crossJoin(F.broadcast(whole)).withColumn(value, F.coalesce(v, "_own", "_all")).drop("_own", "_all")


def share_of(cells: DataFrame, dim: str, value: str = "value") -> Column:
    return clean(value) / F.sum(clean(value)).over(over(dim))

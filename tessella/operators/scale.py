"""Scaling of cells along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import average_rank, clean, global_row_number, null_safe_join, quantiles


def _beside(cells: DataFrame, dim: str, **sums: Column) -> DataFrame:
    """Adds aggregates of each label to its cells: summed before the shuffle and joined back, so a label may hold any share
    of the rows."""
    return null_safe_join(cells, cells.groupBy(dim).agg(*[e.alias(name) for name, e in sums.items()]), [dim], "left")


def log_transform(cells: DataFrame, value: str = "value", base: float | str = 2, pseudocount: float = 1) -> DataFrame:
    x = clean(value) + pseudocount
    x = F.when(x > 0, x)
    return cells.withColumn(value, F.log(x) if base == "e" else F.log(float(base), x))


def normalize(cells: DataFrame, sample: str, feature: str, value: str = "value", method: str = "cpm", target_sum: float = 1e6) -> DataFrame:
    """cpm and total: shares of a sample's sum; zscore: population z within a sample; median_of_ratios: size factors against
    geometric means of features positive in all samples; quantile: every sample gets the mean distribution."""
    v = clean(value)
    if method in ("cpm", "total"):
        return _beside(cells, sample, _sum=F.sum(v)).withColumn(value, v / F.col("_sum") * (target_sum if method == "cpm" else 1.0)).drop("_sum")
    if method == "zscore":
        z = (v - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
        return _beside(cells, sample, _mean=F.avg(v), _sd=F.stddev_pop(v)).withColumn(value, z).drop("_mean", "_sd")
    if method == "median_of_ratios":
        n = cells.select(sample).distinct().count()
        geo = cells.where(v > 0).groupBy(feature).agg(F.avg(F.log(v)).alias("_g"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n)
        ratios = cells.join(geo.select(feature, "_g"), feature).withColumn("_r", F.log(v) - F.col("_g"))
        factors = quantiles(ratios, [sample], "_r", [0.5]).select(sample, F.exp(F.col("q")[0]).alias("_f"))
        return cells.join(factors, sample).withColumn(value, v / F.col("_f")).drop("_f")
    if method == "quantile":
        ranked = global_row_number(cells.where(v.isNotNull()).withColumn("_x", v), "_x", feature, name="_k", within=[sample]).drop("_x")
        size = ranked.groupBy(sample).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n")).first()[0] or 0
        target = ranked.where(F.col("_k") <= size).groupBy("_k").agg(F.avg(v).alias("_t"))
        return ranked.withColumn("_k", F.least("_k", F.lit(size))).join(target, "_k").withColumn(value, F.col("_t")).drop("_k", "_t")
    raise ValueError(f"unknown method {method}")


def zscore(cells: DataFrame, dim: str, value: str = "value") -> DataFrame:
    """Sample standard deviation; no spread divides by 1; missing becomes 0."""
    v = clean(value)
    z = (v - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return _beside(cells, dim, _mean=F.avg(v), _sd=F.stddev_samp(v)).withColumn(value, F.coalesce(z, F.lit(0.0))).drop("_mean", "_sd")


def scale_features(cells: DataFrame, dim: str, value: str = "value", max_value: float | None = None) -> DataFrame:
    """Population standard deviation; under 1e-12 divides by 1; missing stays missing."""
    v = clean(value)
    z = (v - F.col("_mean")) / F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd"))
    scaled = z if max_value is None else F.greatest(F.least(z, F.lit(max_value)), F.lit(-max_value))
    return _beside(cells, dim, _mean=F.avg(v), _sd=F.stddev_pop(v)).withColumn(value, scaled).drop("_mean", "_sd")


def min_max_scale(cells: DataFrame, dim: str, value: str = "value", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """No span and missing cells give `low`."""
    v = clean(value)
    a, b = F.col("_min"), F.col("_max")
    share = F.coalesce(F.when(b > a, (v - a) / (b - a)), F.lit(0.0))
    return _beside(cells, dim, _min=F.min(v), _max=F.max(v)).withColumn(value, low + (high - low) * share).drop("_min", "_max")


def robust_scale(cells: DataFrame, dim: str, value: str = "value") -> DataFrame:
    v = clean(value)
    q = quantiles(cells, [dim], value, [0.25, 0.5, 0.75], "_q")
    span = F.col("_q")[2] - F.col("_q")[0]
    return null_safe_join(cells, q, [dim], "left").withColumn(value, (v - F.col("_q")[1]) / F.when(span > 0, span).otherwise(1.0)).drop("_q")


def softmax(cells: DataFrame, dim: str, value: str = "value") -> DataFrame:
    v = clean(value)
    e = _beside(cells, dim, _max=F.max(v)).withColumn("_e", F.exp(v - F.col("_max"))).drop("_max")
    return _beside(e, dim, _sum=F.sum("_e")).withColumn(value, F.col("_e") / F.col("_sum")).drop("_e", "_sum")


def winsorize(cells: DataFrame, dim: str, value: str = "value", lower: float = 5, upper: float = 95) -> DataFrame:
    v = clean(value)
    q = quantiles(cells, [dim], value, [lower / 100, upper / 100], "_q")
    return null_safe_join(cells, q, [dim], "left").withColumn(value, F.greatest(F.least(v, F.col("_q")[1]), F.col("_q")[0])).drop("_q")


def rank_transform(cells: DataFrame, dim: str, value: str = "value", method: str = "average", ties: tuple[str, ...] = ()) -> DataFrame:
    """Ranks within a label; `ordinal` numbers equal values in the order of `ties`."""
    v = clean(value)
    if method == "ordinal":
        ranked = global_row_number(cells.withColumn("_x", v), "_x", *ties, name="_r", within=[dim]).drop("_x")
    else:
        ranked = average_rank(cells, value, "_r", [dim], method)
    return ranked.withColumn(value, F.when(v.isNotNull(), F.col("_r").cast("double"))).drop("_r")


def flow_transform(cells: DataFrame, value: str = "value", a: float = 1.0, b: float = 1.0, c: float = 0.0) -> DataFrame:
    return cells.withColumn(value, F.asinh(a + b * clean(value)) + c)

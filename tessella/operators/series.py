"""Ordered series, one for each key: autocorrelation, runs, charts, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import clean


def _numbered(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), *order, clean(value).alias("v")).where("v is not null").withColumn("t", F.row_number().over(Window.partitionBy("key").orderBy(*order)))


def acf(rows: DataFrame, key: str, order: list[str], value: str, lags: int = 10) -> DataFrame:
    """Autocorrelation by key and lag (divided by the whole sum of squares)."""
    w, all_ = Window.partitionBy("key").orderBy("t"), Window.partitionBy("key")
    s = _numbered(rows, key, order, value).withColumn("x", F.col("v") - F.avg("v").over(all_))
    products = [F.sum(F.col("x") * F.col(f"x{k}")).alias(f"p{k}") for k in range(1, lags + 1)]
    t = s.select("key", "x", *[F.lag("x", k).over(w).alias(f"x{k}") for k in range(1, lags + 1)]).groupBy("key").agg(F.sum(F.col("x") ** 2).alias("ss"), F.count(F.lit(1)).alias("n"), *products)
    out = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("ss") > 0, F.coalesce(f"p{k}", F.lit(0.0)) / F.col("ss")).alias("acf")) for k in range(1, lags + 1)])).alias("a")
    return t.select("key", "n", out).select("key", "n", "a.lag", "a.acf")


def order_statistics(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """By key: rises, turning points, the von Neumann ratio, runs about the median, and Durbin-Watson's statistic of the centred series."""
    w = Window.partitionBy("key").orderBy("t")
    s = _numbered(rows, key, order, value)
    med = s.groupBy("key").agg(F.percentile("v", 0.5).alias("med"), F.avg("v").alias("mean"))
    s = s.join(med, "key").withColumn("p", F.lag("v").over(w)).withColumn("q", F.lead("v").over(w))
    side = s.where(F.col("v") != F.col("med")).withColumn("up", (F.col("v") > F.col("med")).cast("int"))
    runs = side.withColumn("new", F.coalesce((F.col("up") != F.lag("up").over(w)).cast("int"), F.lit(1))).groupBy("key").agg(F.sum("new").alias("runs"))
    turns = ((F.col("v") > F.col("p")) & (F.col("v") > F.col("q"))) | ((F.col("v") < F.col("p")) & (F.col("v") < F.col("q")))
    t = s.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > F.col("p")).alias("rises"), F.count_if(turns).alias("turning_points"), (F.sum((F.col("v") - F.col("p")) ** 2) / F.sum((F.col("v") - F.col("mean")) ** 2)).alias("von_neumann"))
    return t.join(runs, "key", "left")


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """Centred mean of an odd `width`, missing near the ends; and the rest."""
    half = width // 2
    w = Window.partitionBy("key").orderBy("t").rowsBetween(-half, half)
    s = _numbered(rows, key, order, value).withColumn("c", F.count("v").over(w)).withColumn("trend", F.when(F.col("c") == 2 * half + 1, F.avg("v").over(w)))
    return s.select("key", "t", "v", "trend", (F.col("v") - F.col("trend")).alias("rest"))


def seasonal(rows: DataFrame, key: str, order: list[str], value: str, period: int) -> DataFrame:
    """Additive decomposition with a centred moving average of an odd period; seasonal means add to zero."""
    s = moving_average(rows, key, order, value, period).withColumn("phase", (F.col("t") - 1) % period)
    means = s.groupBy("key", "phase").agg(F.avg("rest").alias("m"))
    means = means.withColumn("seasonal", F.col("m") - F.avg("m").over(Window.partitionBy("key"))).select("key", "phase", "seasonal")
    return s.join(means, ["key", "phase"]).select("key", "t", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("rest"))


def sessions(rows: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Runs of events of one key with gaps of at most `gap_seconds`."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    s = F.unix_timestamp(ts)
    new = F.when(F.lag(s).over(w).isNull() | (s - F.lag(s).over(w) > gap_seconds), 1).otherwise(0)
    return rows.withColumn("_s", s).withColumn("session", F.sum(new).over(w)).groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), (F.max("_s") - F.min("_s")).alias("seconds"))


def cross_correlation(rows: DataFrame, key: str, order: list[str], a: str, b: str, lags: int = 5) -> DataFrame:
    w, all_ = Window.partitionBy("key").orderBy("t"), Window.partitionBy("key")
    s = rows.select(F.col(key).alias("key"), *order, clean(a).alias("a"), clean(b).alias("b")).where("a is not null and b is not null").withColumn("t", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    s = s.withColumn("x", F.col("a") - F.avg("a").over(all_)).withColumn("y", F.col("b") - F.avg("b").over(all_))
    ks = list(range(-lags, lags + 1))
    t = s.select("key", "x", "y", *[F.lead("x", k).over(w).alias(f"x{i}") for i, k in enumerate(ks)]).groupBy("key").agg(F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2)).alias("ss"), *[F.coalesce(F.sum(F.col(f"x{i}") * F.col("y")), F.lit(0.0)).alias(f"p{i}") for i in range(len(ks))])
    out = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("ss") > 0, F.col(f"p{i}") / F.col("ss")).alias("ccf")) for i, k in enumerate(ks)])).alias("c")
    return t.select("key", out).select("key", "c.lag", "c.ccf")

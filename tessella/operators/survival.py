"""Survival: risk sets by distinct time, counted first, so that windows see one row for each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.distributions import chi2_sf
from tessella.operators.common import running


def risk_table(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """By group and time: events d, censored c, at risk n (before the time)."""
    t = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(time).alias("time")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.sum(1 - F.col(event).cast("long")).alias("c"))
    back = running(t.withColumn("_back", -F.col("time")), ["_back"], ["grp"], n=("sum", F.col("d") + F.col("c")))
    return back.drop("_back")


def kaplan_meier(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Survival with Greenwood's variance, at event times."""
    n, d = F.col("n"), F.col("d")
    some = n > d
    t = running(
        risk_table(rows, time, event, group).where("d > 0"), ["time"], ["grp"],
        _s=("sum", F.when(some, F.log(1 - d / n)).otherwise(0.0)), _g=("sum", F.when(some, d / (n * (n - d))).otherwise(0.0)), _gone=("max", (n == d).cast("int")),
    )
    t = t.withColumn("survival", F.when(F.col("_gone") == 1, 0.0).otherwise(F.exp("_s")))
    return t.select("grp", "time", "n", "d", "survival", (F.col("survival") ** 2 * F.col("_g")).alias("variance"))


def nelson_aalen(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    n, d = F.col("n"), F.col("d")
    t = running(risk_table(rows, time, event, group).where("d > 0"), ["time"], ["grp"], hazard=("sum", d / n), variance=("sum", d / n**2))
    return t.select("grp", "time", "n", "d", "hazard", "variance")


def logrank(rows: DataFrame, time: str, event: str, group: str, a, b) -> DataFrame:
    """Observed and expected events of group a against b, variance, chi-square and p."""
    two = rows.where(F.col(group).isin(a, b))
    t = two.groupBy(F.col(time).alias("time")).agg(F.sum(F.col(event)).alias("d"), F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col(group) == a, F.col(event)).otherwise(0)).alias("da"), F.count_if(F.col(group) == a).alias("ma"))
    t = running(t.withColumn("_back", -F.col("time")), ["_back"], [], n=("sum", F.col("m")), na=("sum", F.col("ma"))).where("d > 0")
    n, d, na = F.col("n").cast("double"), F.col("d").cast("double"), F.col("na").cast("double")
    v = F.when(n > 1, d * na / n * (1 - na / n) * (n - d) / (n - 1)).otherwise(0.0)
    s = t.agg(F.sum("da").alias("observed"), F.sum(d * na / n).alias("expected"), F.sum(v).alias("variance"))
    s = s.withColumn("chi2", (F.col("observed") - F.col("expected")) ** 2 / F.col("variance"))
    return s.withColumn("p", chi2_sf(F.col("chi2"), F.lit(1)))


def rmst(rows: DataFrame, time: str, event: str, group: str, tau: float) -> DataFrame:
    """Area under the survival curve up to tau, by group."""
    km = kaplan_meier(rows, time, event, group).where(F.col("time") < tau).select("grp", F.col("time").cast("double").alias("time"), "survival")
    steps = km.unionByName(rows.select(F.col(group).alias("grp")).distinct().select("grp", F.lit(0.0).alias("time"), F.lit(1.0).alias("survival")))
    w = Window.partitionBy("grp").orderBy("time", F.desc("survival"))
    return steps.withColumn("next", F.coalesce(F.lead("time").over(w), F.lit(float(tau)))).groupBy("grp").agg(F.sum((F.col("next") - F.col("time")) * F.col("survival")).alias("rmst"))

"""Ratings of subjects by several raters, trends, strata and control charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.distributions import chi2_sf, normal_sf
from tessella.operators.common import clean


def friedman(cells: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Friedman's chi-square corrected for ties, and Kendall's W; blocks with every treatment."""
    v = clean(value)
    w = Window.partitionBy(block)
    k = cells.select(treatment).distinct().count()
    full = cells.where(v.isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == k)
    r = full.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(block, v))).withColumn("_r", F.rank().over(w.orderBy(v)) + (F.col("_t") - 1) / 2)
    sums = r.groupBy(treatment).agg(F.sum("_r").alias("s"), F.count(F.lit(1)).alias("b")).agg(F.sum(F.col("s") ** 2).alias("s2"), F.max("b").alias("b"))
    ties = r.agg(F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))  # each of t equal values adds t² - 1
    b = F.col("b").cast("double")
    chi = (12 * F.col("s2") / (b * k * (k + 1)) - 3 * b * (k + 1)) / (1 - F.col("ties") / (b * k * (k * k - 1)))
    return sums.crossJoin(ties).select(chi.alias("chi2"), chi2_sf(chi, F.lit(k - 1)).alias("p"), (chi / (b * (k - 1))).alias("kendall_w"), F.col("b").alias("blocks"), F.lit(k).cast("long").alias("treatments"))


def cochran_q(cells: DataFrame, block: str, condition: str, value: str) -> DataFrame:
    """Q of binary responses over complete blocks."""
    k = cells.select(condition).distinct().count()
    full = cells.withColumn("_n", F.count(value).over(Window.partitionBy(block))).where(F.col("_n") == k)
    cols = full.groupBy(condition).agg(F.sum(value).alias("g")).agg(F.sum(F.col("g") ** 2).alias("g2"), F.sum("g").alias("t"))
    rows = full.groupBy(block).agg(F.sum(value).alias("l")).agg(F.sum(F.col("l") ** 2).alias("l2"))
    q = (k - 1) * (k * F.col("g2") - F.col("t") ** 2) / (k * F.col("t") - F.col("l2"))
    return cols.crossJoin(rows).select(q.alias("q"), chi2_sf(q, F.lit(k - 1)).alias("p"))


def fleiss_kappa(counts: DataFrame, subject: str, category: str, n: str, method: str = "fleiss") -> DataFrame:
    """From ratings by subject and category; every subject has the same number of ratings."""
    per = counts.groupBy(subject).agg(F.sum(n).alias("m"), F.sum(F.col(n) * (F.col(n) - 1)).alias("s"))
    po = per.agg(F.avg(F.col("s") / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("total"))
    cats = counts.groupBy(category).agg(F.sum(n).alias("c"))
    pe = cats.crossJoin(po.select("total")).agg((F.sum((F.col("c") / F.col("total")) ** 2) if method == "fleiss" else 1 / F.count(F.lit(1))).alias("pe"))
    return po.crossJoin(pe).select("po", "pe", ((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def mann_kendall(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """S, tau-a, tie-corrected variance and z with continuity correction, by key; pairs within a key."""
    v = clean(value)
    t = rows.where(v.isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("t"), v.alias("v"))
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.t") < F.col("b.t")))
    s = pairs.groupBy(F.col("a.key").alias("key")).agg(F.sum(F.signum(F.col("b.v") - F.col("a.v"))).alias("s"))
    ties = t.groupBy("key", "v").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("ties"))
    n = F.col("n")
    var = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18
    z = F.when(var > 0, (F.col("s") - F.signum("s")) / F.sqrt(var))
    return s.join(ties, "key").select("key", "s", (2 * F.col("s") / (n * (n - 1))).alias("tau"), var.alias("variance"), z.alias("z"), F.least(2 * normal_sf(F.abs(z)), F.lit(1.0)).alias("p"))


def sen_slope(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The median slope of all pairs with different x, and the median intercept, by key."""
    t = rows.select(F.col(key).alias("key"), clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.x") < F.col("b.x")))
    slope = pairs.groupBy(F.col("a.key").alias("key")).agg(F.percentile((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x")), 0.5).alias("slope"), F.count(F.lit(1)).alias("pairs"))
    mid = t.join(slope, "key").groupBy("key").agg(F.percentile(F.col("y") - F.col("slope") * F.col("x"), 0.5).alias("intercept"))
    return slope.join(mid, "key")


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """Pooled odds ratio and chi-square without correction, from strata with cells a, b, c, d."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    var = (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))
    t = tables.where(n > 1).agg(F.sum(a * d / n).alias("p"), F.sum(b * c / n).alias("q"), F.sum(a - (a + b) * (a + c) / n).alias("delta"), F.sum(var).alias("v"))
    return t.select((F.col("p") / F.col("q")).alias("odds_ratio"), (F.col("delta") ** 2 / F.col("v")).alias("chi2"))


def proportion_ci(rows: DataFrame, k: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """Wilson, Wald and Agresti-Coull intervals of k out of n."""
    p, m = F.col(k) / F.col(n), F.col(n).cast("double")
    mid, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    wald = z * F.sqrt(p * (1 - p) / m)
    q, r = (F.col(k) + z * z / 2) / (m + z * z), m + z * z
    ac = z * F.sqrt(q * (1 - q) / r)
    return rows.withColumns({"p": p, "wilson_low": mid - half, "wilson_high": mid + half, "wald_low": p - wald, "wald_high": p + wald, "agresti_low": q - ac, "agresti_high": q + ac})


def ewma_chart(rows: DataFrame, key: str, order: list[str], value: str, lam: float = 0.2, nsigmas: float = 3.0) -> DataFrame:
    """The moving average with its limits about the mean of the series; sigma from moving ranges / 1.128. Carried as a sum of
    scaled terms over the frame, which begins where older weights are below double precision (200 steps or more, by `lam`)."""
    w = Window.partitionBy("key").orderBy("t")
    s = rows.select(F.col(key).alias("key"), *order, clean(value).alias("v")).where("v is not null").withColumn("t", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    s = s.withColumn("mr", F.abs(F.col("v") - F.lag("v").over(w)))
    base = s.groupBy("key").agg(F.avg("v").alias("center"), (F.avg("mr") / 1.128).alias("sigma"))
    steps = max(200, math.ceil(-40 / math.log1p(-lam))) if lam < 1 else 200
    last = F.collect_list("v").over(w.rowsBetween(-steps, 0))
    acc = F.aggregate(last, F.struct(F.lit(None).cast("double").alias("z")), lambda a, x: F.struct((lam * x + (1 - lam) * F.coalesce(a["z"], F.col("center"))).alias("z")))["z"]
    t = s.join(base, "key").withColumn("ewma", acc)
    half = nsigmas * F.col("sigma") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * F.col("t"))))
    return t.select("key", "t", "v", "ewma", (F.col("center") - half).alias("low"), (F.col("center") + half).alias("high"), (F.abs(F.col("ewma") - F.col("center")) > half).alias("signal"))


def meta_analysis(rows: DataFrame, effect: str, variance: str) -> DataFrame:
    """Fixed and random (DerSimonian-Laird) pooled effects, Q, I² and tau²."""
    y, v = clean(effect), clean(variance)
    t = rows.where(y.isNotNull() & (v > 0)).select(y.alias("y"), v.alias("v"))
    f = t.agg(F.sum(1 / F.col("v")).alias("w"), F.sum(F.col("y") / F.col("v")).alias("wy"), F.sum(F.col("y") ** 2 / F.col("v")).alias("wy2"), F.sum(1 / F.col("v") ** 2).alias("w2"), F.count(F.lit(1)).alias("k"))
    q = F.col("wy2") - F.col("wy") ** 2 / F.col("w")
    tau = F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("w") - F.col("w2") / F.col("w")))
    fixed = f.select((F.col("wy") / F.col("w")).alias("fixed"), q.alias("q"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i2"), tau.alias("tau2"), "k")
    r = t.crossJoin(fixed).withColumn("wr", 1 / (F.col("v") + F.col("tau2")))
    return r.groupBy("fixed", "q", "i2", "tau2", "k").agg((F.sum(F.col("wr") * F.col("y")) / F.sum("wr")).alias("random"), F.sqrt(1 / F.sum("wr")).alias("random_se"))


def leave_one_out(rows: DataFrame, study: str, effect: str, variance: str) -> DataFrame:
    """The fixed-effect estimate without each study, from the totals."""
    y, v = clean(effect), clean(variance)
    t = rows.where(y.isNotNull() & (v > 0)).select(study, (1 / v).alias("w"), (y / v).alias("wy"))
    total = t.agg(F.sum("w").alias("tw"), F.sum("wy").alias("twy"))
    return t.crossJoin(total).select(study, ((F.col("twy") - F.col("wy")) / (F.col("tw") - F.col("w"))).alias("effect"), F.sqrt(1 / (F.col("tw") - F.col("w"))).alias("se"))


def cumulative_incidence(rows: DataFrame, time: str, event: str, group: str, of: int = 1) -> DataFrame:
    """Aalen-Johansen incidence of event `of` (0 is censored, other numbers compete)."""
    t = rows.groupBy(F.col(group).alias("grp"), F.col(time).alias("time")).agg(F.count_if(F.col(event) == of).alias("d"), F.count_if(F.col(event) > 0).alias("all"), F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("grp").orderBy("time")
    t = t.withColumn("n", F.sum("m").over(Window.partitionBy("grp").orderBy(F.desc("time")))).where(F.col("all") > 0)
    step = F.log(F.when(F.col("n") > F.col("all"), 1 - F.col("all") / F.col("n")))
    before = F.exp(F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return t.withColumn("inc", before * F.col("d") / F.col("n")).select("grp", "time", "d", "n", F.sum("inc").over(w).alias("incidence"))

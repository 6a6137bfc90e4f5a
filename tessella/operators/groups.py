"""Comparison of groups: moments, effect sizes, rank statistics. One row for each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.distributions import chi2_sf, f_sf, normal_sf, t_two_sided
from tessella.operators.common import clean, counted, quantiles


def moments(rows: DataFrame, feature: list[str], group: str, value: str) -> DataFrame:
    v = clean(value)
    return rows.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(*feature, group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def anova(rows: DataFrame, feature: list[str], group: str, value: str) -> DataFrame:
    """F with its p, eta squared and omega squared of a one-way layout."""
    m = moments(rows, feature, group, value)
    n, k = F.sum("n"), F.count(F.lit(1))
    grand = F.sum(F.col("n") * F.col("mean")) / n
    between = F.sum(F.col("n") * F.col("mean") ** 2) - n * grand**2
    within = F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))
    out = m.groupBy(*feature).agg(between.alias("ssb"), within.alias("ssw"), n.alias("n"), k.alias("k"))
    msw = F.col("ssw") / (F.col("n") - F.col("k"))
    f = F.col("ssb") / (F.col("k") - 1) / msw
    return out.select(*feature, f.alias("f"), f_sf(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta_squared"), ((F.col("ssb") - (F.col("k") - 1) * msw) / (F.col("ssb") + F.col("ssw") + msw)).alias("omega_squared"), "n", "k")


def two_sample(rows: DataFrame, feature: list[str], group: str, value: str, a, b) -> DataFrame:
    """Student's and Welch's t with degrees of freedom, Cohen's d and Hedges' g, of group a against b."""
    m = moments(rows.where(F.col(group).isin(a, b)), feature, group, value)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    t = m.groupBy(*feature).agg(*[pick(c, g).alias(f"{c}_{s}") for c in ("n", "mean", "var") for g, s in ((a, "a"), (b, "b"))]) if feature else m.agg(*[pick(c, g).alias(f"{c}_{s}") for c in ("n", "mean", "var") for g, s in ((a, "a"), (b, "b"))])
    na, nb, va, vb = (F.col(x) for x in ("n_a", "n_b", "var_a", "var_b"))
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    welch = va / na + vb / nb
    d = diff / F.sqrt(pooled)
    t_, df = diff / F.sqrt(pooled * (1 / na + 1 / nb)), welch**2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))
    return t.select(*feature, diff.alias("difference"), t_.alias("t"), t_two_sided(t_, na + nb - 2).alias("p"), (diff / F.sqrt(welch)).alias("welch_t"), df.alias("welch_df"), t_two_sided(diff / F.sqrt(welch), df).alias("welch_p"), d.alias("cohens_d"), (d * (1 - 3 / (4 * (na + nb) - 9))).alias("hedges_g"))


def levene(rows: DataFrame, feature: list[str], group: str, value: str, center: str = "median") -> DataFrame:
    """Levene's (mean) or Brown-Forsythe's (median) W: the F of absolute deviations."""
    v = clean(value)
    keys = [*feature, group]
    mid = quantiles(rows, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("_mid")) if center == "median" else rows.groupBy(*keys).agg(F.avg(v).alias("_mid"))
    dev = rows.join(mid, [*feature, group]).withColumn("_dev", F.abs(v - F.col("_mid")))
    return anova(dev, feature, group, "_dev").select(*feature, F.col("f").alias("w"), "p", "n", "k")


def _ranked(rows: DataFrame, feature: list[str], value: str) -> DataFrame:
    """Average ranks within a feature and tie sizes, from counts of distinct values, so that a value many rows share is one row."""
    spans = counted(rows, feature, value)
    return spans.select(*feature, "_v", F.col("_c").alias("_t"), (F.col("_upto") - (F.col("_c") - 1) / 2).alias("_rank"))


def rank_tests(rows: DataFrame, feature: list[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H corrected for ties, and epsilon squared."""
    r = _ranked(rows, feature, value)
    v = clean(value)
    tally = rows.where(v.isNotNull()).groupBy(*feature, group, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).join(r, [*feature, "_v"])
    sums = tally.groupBy(*feature, group).agg(F.sum(F.col("_n") * F.col("_rank")).alias("s"), F.sum("_n").alias("n"))
    h = sums.groupBy(*feature).agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("s2"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ties = r.groupBy(*feature).agg(F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("ties"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s2") - 3 * (n + 1)
    both = h.join(ties, feature) if feature else h.crossJoin(ties)
    hc = raw / (1 - F.col("ties") / (n**3 - n))
    return both.select(*feature, hc.alias("h"), chi2_sf(hc, F.col("k") - 1).alias("p"), (hc / (n - 1)).alias("epsilon_squared"), "n", "k")


def mann_whitney(rows: DataFrame, feature: list[str], group: str, value: str, a, b) -> DataFrame:
    """U of group a, Cliff's delta (rank-biserial) and the tie-corrected z without continuity correction."""
    two = rows.where(F.col(group).isin(a, b))
    r = _ranked(two, feature, value)
    v = clean(value)
    tally = two.where(v.isNotNull()).groupBy(*feature, v.alias("_v")).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b")).join(r, [*feature, "_v"])
    agg = [F.sum(F.col("_a") * F.col("_rank")).alias("s"), F.sum("_a").cast("double").alias("na"), F.sum("_b").cast("double").alias("nb"), F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("ties")]
    t = tally.groupBy(*feature).agg(*agg)
    na, nb = F.col("na"), F.col("nb")
    u = F.col("s") - na * (na + 1) / 2
    n = na + nb
    var = na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = (u - na * nb / 2) / F.sqrt(var)
    return t.select(*feature, u.alias("u"), (2 * u / (na * nb) - 1).alias("cliffs_delta"), z.alias("z"), F.least(2 * normal_sf(F.abs(z)), F.lit(1.0)).alias("p"))


def summary_quantiles(rows: DataFrame, feature: list[str], value: str) -> DataFrame:
    """Quartiles, IQR, Tukey fences and how many values lie beyond them."""
    v = clean(value)
    q = quantiles(rows, feature, value, [0.25, 0.5, 0.75])
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    return rows.join(q, feature).groupBy(*feature).agg(F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.count_if((v < low) | (v > high)).alias("outliers"))


def moments_shape(rows: DataFrame, feature: list[str], value: str) -> DataFrame:
    """Skewness and excess kurtosis of the population, and the Jarque-Bera statistic."""
    v, rows = F.col("_v"), rows.select(*feature, clean(value).alias("_v"))  # once a row: each moment names it many times
    t = rows.groupBy(*feature).agg(F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), F.count(v).alias("n"))
    return t.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4))

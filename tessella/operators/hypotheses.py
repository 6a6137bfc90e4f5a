"""Tests with their probabilities: location, dispersion, normality, counts and series. One row for each feature.

Sums of groups, or counts of distinct values, are gathered by Spark; a tail probability is one value for each result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.distributions import binomial_two_sided, chi2_sf, f_sf, hypergeometric_sf, normal_sf, t_two_sided
from tessella.operators.common import clean, null_safe_join, quantiles
from tessella.operators.groups import _ranked, moments

Columns = list[str]


def normal_p(z: Column, alternative: str = "two-sided") -> Column:
    """The probability of a standard normal statistic at least as extreme."""
    if alternative == "two-sided":
        return F.least(2 * normal_sf(F.abs(z)), F.lit(1.0))
    return normal_sf(z if alternative == "greater" else -z)


def t_p(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    """The same for Student's t."""
    both = t_two_sided(t, df)
    if alternative == "two-sided":
        return both
    return F.when(t > 0 if alternative == "greater" else t < 0, both / 2).otherwise(1 - both / 2)


def pairs_of(rows: DataFrame, feature: Columns, unit: str, group: str, value: str, a, b) -> DataFrame:
    """feature, x and y: the values of a unit in groups a and b, where it has both."""
    v = clean(value)
    pick = lambda g: F.max(F.when(F.col(group) == g, v))
    return rows.where(F.col(group).isin(a, b)).groupBy(*feature, unit).agg(pick(a).alias("x"), pick(b).alias("y")).where("x is not null and y is not null")


# location


def one_sample_t(rows: DataFrame, feature: Columns, value: str, popmean: float = 0.0, alternative: str = "two-sided") -> DataFrame:
    """Student's t of a mean against `popmean`; missing p where there is no spread."""
    v = clean(value)
    s = rows.groupBy(*feature).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    t = F.when(F.col("sd") > 0, (F.col("mean") - popmean) / (F.col("sd") / F.sqrt("n")))
    return s.select(*feature, "n", "mean", t.alias("t"), t_p(t, F.col("n") - 1, alternative).alias("p"))


def paired_t(pairs: DataFrame, feature: Columns, alternative: str = "two-sided") -> DataFrame:
    """Student's t of the differences x - y."""
    out = one_sample_t(pairs.withColumn("_d", F.col("x") - F.col("y")), feature, "_d", 0.0, alternative)
    return out.withColumnRenamed("mean", "difference")


def welch_anova(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Welch's F of groups with unequal variances; a feature with a group without spread has no result."""
    m = moments(rows, feature, group, value).withColumn("w", F.col("n") / F.col("var"))
    w, mean, rest = F.col("w"), F.col("mean"), F.col("n") - 1
    s = m.groupBy(*feature).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * mean).alias("sm"), F.sum(w * mean**2).alias("s2"), F.sum(1 / rest).alias("r0"), F.sum(w / rest).alias("r1"), F.sum(w * w / rest).alias("r2"), F.min("var").alias("least"))
    k, sw = F.col("k"), F.col("sw")
    lam = F.col("r0") - 2 * F.col("r1") / sw + F.col("r2") / sw**2
    f = (F.col("s2") - F.col("sm") ** 2 / sw) / (k - 1) / (1 + 2 * (k - 2) / (k**2 - 1) * lam)
    s = s.where((F.col("least") > 0) & (k > 1)).select(*feature, f.alias("f"), (k - 1).alias("df1"), ((k**2 - 1) / (3 * lam)).alias("df2"))
    return s.withColumn("p", f_sf(F.col("f"), F.col("df1"), F.col("df2")))


def wilcoxon(pairs: DataFrame, feature: Columns, alternative: str = "two-sided") -> DataFrame:
    """Signed ranks of the differences that are not zero: the sum of positive ranks, z corrected for ties, and p."""
    d = pairs.withColumn("_d", F.col("x") - F.col("y")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    ranks = _ranked(d, feature, "_a")
    up = d.groupBy(*feature, F.col("_a").alias("_v")).agg(F.count_if(F.col("_d") > 0).alias("_up"))
    t = F.col("_t").cast("double")
    s = up.join(ranks, [*feature, "_v"]).groupBy(*feature).agg(F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum("_t").alias("n"), F.sum(t**3 - t).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select(*feature, "n", "w_plus", (n * (n + 1) / 2 - F.col("w_plus")).alias("w_minus"), z.alias("z"), normal_p(z, alternative).alias("p"))


def sign_test(pairs: DataFrame, feature: Columns) -> DataFrame:
    """Differences above and below zero, and the exact two-sided binomial p."""
    d = F.col("x") - F.col("y")
    s = pairs.groupBy(*feature).agg(F.count_if(d > 0).alias("above"), F.count_if(d < 0).alias("below"))
    return s.withColumn("p", binomial_two_sided(F.col("above"), F.col("above") + F.col("below"), F.lit(0.5)))


def _joint_ranks(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """feature, group, _v, _n rows of the group with the value, _t of all groups, and the value's average rank over all."""
    v = clean(value)
    tally = rows.where(v.isNotNull() & F.col(group).isNotNull()).groupBy(*feature, F.col(group).alias("g"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return tally.join(_ranked(rows.where(F.col(group).isNotNull()), feature, value), [*feature, "_v"])


def brunner_munzel(rows: DataFrame, feature: Columns, group: str, value: str, a, b) -> DataFrame:
    """The probability that group b is larger (ties half), Brunner and Munzel's statistic, its degrees of freedom and p."""
    r = _joint_ranks(rows.where(F.col(group).isin(a, b)), feature, group, value)
    w = Window.partitionBy(*feature, "g").orderBy("_v")
    r = r.withColumn("_own", F.sum("_n").over(w) - (F.col("_n") - 1) / 2).withColumn("_d", F.col("_rank") - F.col("_own"))
    per = r.groupBy(*feature, "g").agg(F.sum("_n").cast("double").alias("n"), (F.sum(F.col("_n") * F.col("_rank")) / F.sum("_n")).alias("m"), F.sum(F.col("_n") * F.col("_d")).alias("s1"), F.sum(F.col("_n") * F.col("_d") ** 2).alias("s2"))
    per = per.withColumn("v", (F.col("s2") - F.col("s1") ** 2 / F.col("n")) / (F.col("n") - 1))
    pick = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    t = per.groupBy(*feature).agg(*[pick(c, g).alias(f"{c}{s}") for c in "nmv" for g, s in ((a, "a"), (b, "b"))])
    na, nb, va, vb = (F.col(x) for x in ("na", "nb", "va", "vb"))
    stat = na * nb * (F.col("mb") - F.col("ma")) / (na + nb) / F.sqrt(na * va + nb * vb)
    df = (na * va + nb * vb) ** 2 / ((na * va) ** 2 / (na - 1) + (nb * vb) ** 2 / (nb - 1))
    return t.select(*feature, ((F.col("mb") - (nb + 1) / 2) / na).alias("larger"), stat.alias("statistic"), df.alias("df"), t_two_sided(stat, df).alias("p"))


def median_test(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Mood's median test: rows above the joint median against the others, by group; chi-square without correction."""
    v = clean(value)
    used = rows.where(v.isNotNull() & F.col(group).isNotNull())
    tally = used.groupBy(*feature, F.col(group).alias("g"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    mid = quantiles(tally, feature, "_v", [0.5], weight="_n").select(*feature, F.col("q")[0].alias("median"))
    per = tally.join(mid, feature).groupBy(*feature, "median", "g").agg(F.sum(F.when(F.col("_v") > F.col("median"), F.col("_n")).otherwise(0)).cast("double").alias("o"), F.sum("_n").cast("double").alias("n"))
    per = per.groupBy(*feature, "median").agg(F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum(F.col("o") ** 2 / F.col("n")).alias("q"), F.count(F.lit(1)).alias("k"))
    o, n = F.col("o"), F.col("n")
    chi = (F.col("q") - o * o / n) * n * n / (o * (n - o))
    return per.select(*feature, "median", chi.alias("chi2"), (F.col("k") - 1).alias("df"), chi2_sf(chi, F.col("k") - 1).alias("p"))


def mood_scale(rows: DataFrame, feature: Columns, group: str, value: str, a, b) -> DataFrame:
    """Mood's test of dispersion: squared distances of group a's ranks from the middle; z without correction for ties."""
    r = _joint_ranks(rows.where(F.col(group).isin(a, b)), feature, group, value)
    size = r.groupBy(*feature).agg(F.sum("_n").cast("double").alias("n"))
    s = r.join(size, feature).where(F.col("g") == a).groupBy(*feature, "n").agg(F.sum("_n").cast("double").alias("na"), F.sum(F.col("_n") * (F.col("_rank") - (F.col("n") + 1) / 2) ** 2).alias("m"))
    n, na = F.col("n"), F.col("na")
    z = (F.col("m") - na * (n * n - 1) / 12) / F.sqrt(na * (n - na) * (n + 1) * (n + 2) * (n - 2) / 180)
    return s.select(*feature, F.col("m").alias("statistic"), z.alias("z"), normal_p(z).alias("p"))


def _rank_sums(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """feature, g, n, rank sum s, sum of squared ranks s2, and of the feature: all rows and ties."""
    r = _joint_ranks(rows, feature, group, value)
    per = r.groupBy(*feature, "g").agg(F.sum("_n").cast("double").alias("n"), F.sum(F.col("_n") * F.col("_rank")).alias("s"), F.sum(F.col("_n") * F.col("_rank") ** 2).alias("s2"))
    t = F.col("_t").cast("double")
    ties = r.dropDuplicates([*feature, "_v"]).groupBy(*feature).agg(F.sum(t).alias("all"), F.sum(t**3 - t).alias("ties"))
    return per.join(ties, feature)


def _group_pairs(per: DataFrame, feature: Columns) -> DataFrame:
    """Each two groups of a feature, the lesser as a."""
    one = lambda s: per.select(*feature, *[F.col(c).alias(f"{c}_{s}") for c in per.columns if c not in feature])
    return one("a").join(one("b"), feature).where("g_a < g_b")


def dunn(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Dunn's z for each two groups, corrected for ties, with p before and after Bonferroni's correction."""
    per = _rank_sums(rows, feature, group, value)
    t = _group_pairs(per, feature)
    n = F.col("all_a")
    var = (n * (n + 1) / 12 - F.col("ties_a") / (12 * (n - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b"))
    z = (F.col("s_a") / F.col("n_a") - F.col("s_b") / F.col("n_b")) / F.sqrt(var)
    t = t.select(*feature, F.col("g_a").alias("a"), F.col("g_b").alias("b"), z.alias("z")).withColumn("p", normal_p(F.col("z")))
    return t.withColumn("adjusted", F.least(F.col("p") * F.count(F.lit(1)).over(Window.partitionBy(*feature)), F.lit(1.0)))


def conover(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Conover and Iman's t for each two groups after Kruskal and Wallis."""
    per = _rank_sums(rows, feature, group, value)
    whole = per.groupBy(*feature).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("s") ** 2 / F.col("n")).alias("q"), F.sum("s2").alias("r2"))
    t = _group_pairs(per, feature).join(whole, feature)
    n = F.col("all_a")
    s2 = (F.col("r2") - n * (n + 1) ** 2 / 4) / (n - 1)
    h = (F.col("q") - n * (n + 1) ** 2 / 4) / s2
    stat = (F.col("s_a") / F.col("n_a") - F.col("s_b") / F.col("n_b")) / F.sqrt(s2 * (n - 1 - h) / (n - F.col("k")) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return t.select(*feature, F.col("g_a").alias("a"), F.col("g_b").alias("b"), stat.alias("t"), t_two_sided(stat, n - F.col("k")).alias("p"))


def scheffe(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Scheffe's F of the difference of each two group means."""
    m = moments(rows, feature, group, value).withColumnRenamed(group, "g")
    whole = m.groupBy(*feature).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"))
    t = _group_pairs(m, feature).join(whole, feature)
    k, n = F.col("k"), F.col("all")
    f = (F.col("mean_a") - F.col("mean_b")) ** 2 / (F.col("ssw") / (n - k) * (1 / F.col("n_a") + 1 / F.col("n_b")) * (k - 1))
    return t.select(*feature, F.col("g_a").alias("a"), F.col("g_b").alias("b"), (F.col("mean_a") - F.col("mean_b")).alias("difference"), f.alias("f"), f_sf(f, k - 1, n - k).alias("p"))


def tamhane(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Tamhane's T2: Welch's t of each two groups, p by Sidak's correction."""
    m = moments(rows, feature, group, value).withColumnRenamed(group, "g")
    t = _group_pairs(m, feature)
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    stat, df = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))
    t = t.select(*feature, F.col("g_a").alias("a"), F.col("g_b").alias("b"), stat.alias("t"), df.alias("df"), t_two_sided(stat, df).alias("raw"))
    return t.withColumn("p", 1 - (1 - F.col("raw")) ** F.count(F.lit(1)).over(Window.partitionBy(*feature))).drop("raw")


def cuzick(rows: DataFrame, feature: Columns, score: str, value: str) -> DataFrame:
    """Cuzick's trend of ranks over numeric group scores, corrected for ties."""
    per = _rank_sums(rows, feature, score, value)
    s = per.groupBy(*feature).agg(F.sum(F.col("g") * F.col("s")).alias("t"), F.sum(F.col("g") * F.col("n")).alias("l"), F.sum(F.col("g") ** 2 * F.col("n")).alias("l2"), F.max("all").alias("n"), F.max("ties").alias("ties"))
    n, el = F.col("n"), F.col("l")
    var = (n + 1) / 12 * (n * F.col("l2") - el**2) * (1 - F.col("ties") / (n**3 - n))
    z = (F.col("t") - (n + 1) * el / 2) / F.sqrt(var)
    return s.select(*feature, F.col("t").alias("statistic"), z.alias("z"), normal_p(z).alias("p"))


# dispersion


def bartlett(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Bartlett's chi-square of equal variances; a feature with a group without spread has no result."""
    m = moments(rows, feature, group, value)
    f = F.col("n") - 1
    s = m.groupBy(*feature).agg(F.count(F.lit(1)).alias("k"), F.sum(f).alias("f"), F.sum(f * F.col("var")).alias("ss"), F.sum(f * F.ln("var")).alias("logs"), F.sum(1 / f).alias("inverse"), F.min("var").alias("least"))
    k = F.col("k")
    chi = (F.col("f") * F.ln(F.col("ss") / F.col("f")) - F.col("logs")) / (1 + (F.col("inverse") - 1 / F.col("f")) / (3 * (k - 1)))
    return s.where((F.col("least") > 0) & (k > 1)).select(*feature, chi.alias("chi2"), (k - 1).alias("df"), chi2_sf(chi, k - 1).alias("p"))


def var_test(rows: DataFrame, feature: Columns, group: str, value: str, a, b) -> DataFrame:
    """The ratio of two variances and its two-sided p."""
    m = moments(rows.where(F.col(group).isin(a, b)), feature, group, value)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    t = m.groupBy(*feature).agg(*[pick(c, g).alias(f"{c}_{s}") for c in ("n", "var") for g, s in ((a, "a"), (b, "b"))])
    f = F.col("var_a") / F.col("var_b")
    above = f_sf(f, F.col("n_a") - 1, F.col("n_b") - 1)
    return t.select(*feature, f.alias("f"), (2 * F.least(above, 1 - above)).alias("p"))


def cochran_c(rows: DataFrame, feature: Columns, group: str, value: str) -> DataFrame:
    """Cochran's C, the largest variance over their sum, with the upper-tail p for groups of their mean size."""
    m = moments(rows, feature, group, value)
    s = m.groupBy(*feature).agg((F.max("var") / F.sum("var")).alias("c"), F.avg("n").alias("n"), F.count(F.lit(1)).alias("k"))
    k, c, n = F.col("k"), F.col("c"), F.col("n")
    p = k * f_sf(c * (k - 1) / (1 - c), n - 1, (n - 1) * (k - 1))
    return s.select(*feature, "c", "k", F.least(p, F.lit(1.0)).alias("p"))


# normality


def normality(rows: DataFrame, feature: Columns, value: str) -> DataFrame:
    """Moments and the tests built on them: Jarque and Bera's, D'Agostino's of skewness, Anscombe and Glynn's of kurtosis,
    and D'Agostino and Pearson's of both. At least 20 values are wanted; fewer give missing statistics."""
    v, t = F.col("_v"), rows.select(*feature, clean(value).alias("_v"))  # once a row: each moment names it many times
    s = t.groupBy(*feature).agg(F.count(v).alias("n"), F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis")).where("n >= 20")
    n, g, k = F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis")
    jb = n / 6 * (g**2 + (k - 3) ** 2 / 4)
    y = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    zs = F.asinh(y / alpha) / F.sqrt(0.5 * F.ln(w2))
    x = (k - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / beta**2))
    part = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    zk = (1 - 2 / (9 * a) - F.signum(part) * F.pow(F.abs(part), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    s = s.select(*feature, "n", "skewness", "kurtosis", jb.alias("jarque_bera"), zs.alias("z_skewness"), zk.alias("z_kurtosis"))
    both = F.col("z_skewness") ** 2 + F.col("z_kurtosis") ** 2
    return s.withColumn("k2", both).withColumns({"p_jarque_bera": chi2_sf(F.col("jarque_bera"), F.lit(2)), "p_skewness": normal_p(F.col("z_skewness")), "p_kurtosis": normal_p(F.col("z_kurtosis")), "p_k2": chi2_sf(F.col("k2"), F.lit(2))})


def bonett_seier(rows: DataFrame, feature: Columns, value: str) -> DataFrame:
    """Bonett and Seier's test of Geary's kurtosis."""
    v = clean(value)
    mid = rows.groupBy(*feature).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    s = rows.join(mid, feature).groupBy(*feature, "_s").agg(F.count(v).alias("n"), F.avg(F.abs(v - F.col("_m"))).alias("tau")).where("tau > 0")
    z = F.sqrt(F.col("n") + 2) * (13.29 * (F.ln("_s") - F.ln("tau")) - 3) / 3.54
    return s.select(*feature, "tau", z.alias("z"), normal_p(z).alias("p"))


# counts


def chi_square_gof(rows: DataFrame, feature: Columns, category: str, expected: dict | None = None) -> DataFrame:
    """Counts of categories against expected shares (equal ones if none are given), by chi-square and by G. Categories
    without a row count as zero where shares are given."""
    c = rows.where(F.col(category).isNotNull()).groupBy(*feature).agg(F.count(F.lit(1)).alias("n"))
    o = rows.where(F.col(category).isNotNull()).groupBy(*feature, F.col(category).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    if expected:
        total = sum(expected.values())
        share = F.create_map(*[F.lit(x) for k, v in expected.items() for x in (k, float(v) / total)])
        o = o.withColumn("e", F.element_at(share, F.col("c")))
        k = F.lit(len(expected)).cast("long")
    else:
        k = F.count(F.lit(1))
        o = o.withColumn("e", F.lit(None).cast("double"))
    per = o.groupBy(*feature).agg(k.alias("k"), F.sum(F.col("o") ** 2 / F.coalesce("e", F.lit(1.0))).alias("q"), F.sum(F.col("o") * F.ln(F.col("o") / F.coalesce("e", F.lit(1.0)))).alias("g")).join(c, feature)
    n, even = F.col("n"), F.lit(1.0) if expected else F.col("k")
    chi, g = F.col("q") * even / n - n, 2 * (F.col("g") + n * F.ln(even) - n * F.ln(n))
    return per.select(*feature, "n", chi.alias("chi2"), (F.col("k") - 1).alias("df"), chi2_sf(chi, F.col("k") - 1).alias("p"), g.alias("g"), chi2_sf(g, F.col("k") - 1).alias("p_g"))


def binomial_test(rows: DataFrame, feature: Columns, success: Column, probability: float = 0.5) -> DataFrame:
    """Successes among rows and the exact two-sided p."""
    s = rows.where(success.isNotNull()).groupBy(*feature).agg(F.count_if(success).alias("k"), F.count(F.lit(1)).alias("n"))
    return s.select(*feature, "k", "n", (F.col("k") / F.col("n")).alias("share"), binomial_two_sided(F.col("k"), F.col("n"), F.lit(probability)).alias("p"))


def poisson_test(rows: DataFrame, feature: Columns, events: str, rate: float) -> DataFrame:
    """Events against the rate for each row: the ratio, and the probability of at least as many, and of at most as many."""
    s = rows.groupBy(*feature).agg(F.sum(events).alias("events"), F.count(events).alias("exposure"))
    k, mean = F.col("events"), F.col("exposure") * rate
    # P(X <= k) is the upper tail of a gamma distribution
    most, fewer = chi2_sf(2 * mean, 2 * (k + 1)), F.when(k > 0, chi2_sf(2 * mean, 2 * k)).otherwise(0.0)
    return s.select(*feature, "events", "exposure", (k / mean).alias("ratio"), (1 - fewer).alias("p_greater"), most.alias("p_less"))


def fisher_exact(rows: DataFrame, feature: Columns, x: Column, y: Column) -> DataFrame:
    """Cells of the two-by-two table, the odds ratio, and the probability of at least as many in both (one-sided)."""
    s = rows.where(x.isNotNull() & y.isNotNull()).groupBy(*feature).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    a, b, c, d = (F.col(i) for i in "abcd")
    odds = F.when(b * c > 0, a * d / (b * c))
    return s.select(*feature, "a", "b", "c", "d", odds.alias("odds_ratio"), hypergeometric_sf(a, a + b + c + d, a + b, a + c).alias("p_greater"), (1 - hypergeometric_sf(a + 1, a + b + c + d, a + b, a + c)).alias("p_less"))


def cochran_armitage(rows: DataFrame, feature: Columns, score: str, case: Column) -> DataFrame:
    """Trend of a share over numeric scores: z and p."""
    per = rows.where(F.col(score).isNotNull() & case.isNotNull()).groupBy(*feature, F.col(score).cast("double").alias("w")).agg(F.count_if(case).cast("double").alias("r"), F.count(F.lit(1)).cast("double").alias("n"))
    w, n = F.col("w"), F.col("n")
    s = per.groupBy(*feature).agg(F.sum(w * F.col("r")).alias("wr"), F.sum("r").alias("r"), F.sum("n").alias("n"), F.sum(w * n).alias("wn"), F.sum(w * w * n).alias("w2n"))
    p = F.col("r") / F.col("n")
    z = (F.col("wr") - p * F.col("wn")) / F.sqrt(p * (1 - p) * (F.col("w2n") - F.col("wn") ** 2 / F.col("n")))
    return s.select(*feature, z.alias("z"), normal_p(z).alias("p"))


def woolf(tables: DataFrame) -> DataFrame:
    """Woolf's test that strata (cells a, b, c, d, with 0.5 added to each) have one odds ratio."""
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    t = tables.select(F.ln(a * d / (b * c)).alias("l"), (1 / (1 / a + 1 / b + 1 / c + 1 / d)).alias("w"))
    s = t.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("l")).alias("wl"), F.sum(F.col("w") * F.col("l") ** 2).alias("wl2"), F.count(F.lit(1)).alias("k"))
    chi = F.col("wl2") - F.col("wl") ** 2 / F.col("w")
    return s.select(chi.alias("chi2"), (F.col("k") - 1).alias("df"), chi2_sf(chi, F.col("k") - 1).alias("p"), F.exp(F.col("wl") / F.col("w")).alias("pooled"))


def stuart_maxwell(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Marginal homogeneity of three categories in pairs, by the closed form; categories in their order."""
    t = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).groupBy(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(F.col(x) < F.col(y), 1.0).otherwise(-1.0)).alias("d"))
    names = rows.select(F.col(x).alias("v")).union(rows.select(F.col(y))).where("v is not null").distinct().orderBy("v").limit(4).collect()
    if len(names) != 3:
        raise ValueError("three categories are wanted")
    one, two, three = (r["v"] for r in names)
    cell = lambda c, i, j: F.coalesce(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c))), F.lit(0.0))
    s = t.agg(*[cell(c, i, j).alias(f"{c}{k}") for c in "nd" for k, (i, j) in {"12": (one, two), "13": (one, three), "23": (two, three)}.items()])
    d1, d2, d3 = F.col("d12") + F.col("d13"), F.col("d23") - F.col("d12"), -F.col("d13") - F.col("d23")
    n12, n13, n23 = F.col("n12"), F.col("n13"), F.col("n23")
    chi = (n23 * d1**2 + n13 * d2**2 + n12 * d3**2) / (n12 * n23 + n12 * n13 + n13 * n23)
    return s.select(chi.alias("chi2"), F.lit(2).cast("long").alias("df"), chi2_sf(chi, F.lit(2)).alias("p"))


# series


def portmanteau(acf: DataFrame) -> DataFrame:
    """From rows (key, n, lag, acf): Box and Pierce's and Ljung and Box's statistics over all lags, with p."""
    r2, n = F.col("acf") ** 2, F.col("n")
    s = acf.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("lags"), (F.max(n) * F.sum(r2)).alias("box_pierce"), (F.max(n) * (F.max(n) + 2) * F.sum(F.when(n > F.col("lag"), r2 / (n - F.col("lag"))))).alias("ljung_box"))
    return s.where("box_pierce is not null").select("key", "n", "lags", "box_pierce", chi2_sf(F.col("box_pierce"), F.col("lags")).alias("p_box_pierce"), "ljung_box", chi2_sf(F.col("ljung_box"), F.col("lags")).alias("p_ljung_box"))


def order_tests(order: DataFrame) -> DataFrame:
    """From `series.order_statistics`: z and p of turning points, and of rises (difference sign); n above 2."""
    n = F.col("n").cast("double")
    tp = (F.col("turning_points") - 2 * (n - 2) / 3) / F.sqrt((16 * n - 29) / 90)
    ds = (F.col("rises") - (n - 1) / 2) / F.sqrt((n + 1) / 12)
    return order.where("n > 2").select("key", "n", tp.alias("z_turning_point"), normal_p(tp).alias("p_turning_point"), ds.alias("z_difference_sign"), normal_p(ds).alias("p_difference_sign"))


def runs_test(rows: DataFrame, key: str, order: Columns, value: str) -> DataFrame:
    """Wald and Wolfowitz's runs about the median, without the values that equal it: z and p."""
    v = clean(value)
    mid = quantiles(rows, [key], v, [0.5]).select(key, F.col("q")[0].alias("_mid"))
    t = rows.join(mid, key).where(v != F.col("_mid")).withColumn("_up", v > F.col("_mid"))
    t = t.withColumn("_new", F.coalesce((F.col("_up") != F.lag("_up").over(Window.partitionBy(key).orderBy(*order))).cast("int"), F.lit(1)))
    s = t.groupBy(F.col(key).alias("key")).agg(F.sum("_new").alias("runs"), F.count_if("_up").cast("double").alias("a"), F.count_if(~F.col("_up")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    n, ab = a + b, 2 * a * b
    var = ab * (ab - n) / (n * n * (n - 1))
    z = F.when(var > 0, (F.col("runs") - ab / n - 1) / F.sqrt(var))
    return s.select("key", "runs", a.cast("long").alias("above"), b.cast("long").alias("below"), z.alias("z"), normal_p(z).alias("p"))


def cox_stuart(rows: DataFrame, key: str, order: Columns, value: str) -> DataFrame:
    """Cox and Stuart's trend: values of the first half against those of the second (the middle one of an odd number is left out)."""
    v = clean(value)
    t = rows.where(v.isNotNull()).withColumn("_t", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    t = t.select(F.col(key).alias("key"), "_t", v.alias("v"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    half = F.floor(F.col("_n") / 2)
    slot = F.when(F.col("_t") <= half, F.col("_t")).when(F.col("_t") > F.col("_n") - half, F.col("_t") - (F.col("_n") - half))
    pairs = t.withColumn("_s", slot).where("_s is not null").groupBy("key", "_s").agg(F.max(F.when(F.col("_t") > half, F.col("v"))).alias("x"), F.max(F.when(F.col("_t") <= half, F.col("v"))).alias("y"))
    return sign_test(pairs, ["key"])


def bartels(rows: DataFrame, key: str, order: Columns, value: str) -> DataFrame:
    """Bartels' rank version of von Neumann's ratio: the ratio, z by its large-sample variance, and p."""
    v = clean(value)
    t = rows.where(v.isNotNull()).select(F.col(key).alias("key"), v.alias("_v"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    t = t.join(_ranked(t, ["key"], "_v"), ["key", "_v"])
    t = t.withColumn("_d", F.col("_rank") - F.lag("_rank").over(Window.partitionBy("key").orderBy(*[f"_o{i}" for i in range(len(order))])))
    s = t.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("_d") ** 2).alias("d"), F.sum(F.col("_rank") ** 2).alias("r"))
    n = F.col("n")
    ratio = F.col("d") / (F.col("r") - n * (n + 1) ** 2 / 4)
    z = (ratio - 2) / F.sqrt(4 * (n - 2) * (5 * n * n - 2 * n - 9) / (5 * n * (n + 1) * (n - 1) ** 2))
    return s.where("n > 2").select("key", n.cast("long").alias("n"), ratio.alias("ratio"), z.alias("z"), normal_p(z).alias("p"))


# outliers and effects


def grubbs(rows: DataFrame, feature: Columns, value: str) -> DataFrame:
    """The largest distance from the mean in standard deviations, and its two-sided p."""
    v = clean(value)
    s = rows.groupBy(*feature).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"), F.max(v).alias("high"), F.min(v).alias("low")).where("sd > 0 and n > 2")
    n = F.col("n").cast("double")
    g = F.greatest(F.col("high") - F.col("m"), F.col("m") - F.col("low")) / F.col("sd")
    t = F.sqrt(n * (n - 2) * g**2 / ((n - 1) ** 2 - n * g**2))
    return s.select(*feature, "n", g.alias("g"), F.least(n * t_two_sided(t, n - 2), F.lit(1.0)).alias("p"))


def chi_square_outlier(rows: DataFrame, feature: Columns, value: str) -> DataFrame:
    """The largest squared distance from the mean over the variance, as chi-square of one degree."""
    v = clean(value)
    s = rows.groupBy(*feature).agg(F.avg(v).alias("m"), F.var_samp(v).alias("var"), F.max(v).alias("high"), F.min(v).alias("low")).where("var > 0")
    chi = F.greatest(F.col("high") - F.col("m"), F.col("m") - F.col("low")) ** 2 / F.col("var")
    return s.select(*feature, chi.alias("chi2"), chi2_sf(chi, F.lit(1)).alias("p"))


def fisher_combined(rows: DataFrame, feature: Columns, p: str) -> DataFrame:
    """Fisher's combination of p-values in (0, 1]."""
    s = rows.where((F.col(p) > 0) & (F.col(p) <= 1)).groupBy(*feature).agg((-2 * F.sum(F.ln(p))).alias("chi2"), F.count(F.lit(1)).alias("_n"))
    return s.select(*feature, "chi2", (2 * F.col("_n")).alias("df"), chi2_sf(F.col("chi2"), 2 * F.col("_n")).alias("p"))


def equivalence(rows: DataFrame, feature: Columns, group: str, value: str, a, b, low: float, high: float) -> DataFrame:
    """Two one-sided tests, by Welch's t, that the difference a - b lies within (low, high); p is the larger of the two."""
    m = moments(rows.where(F.col(group).isin(a, b)), feature, group, value)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    t = m.groupBy(*feature).agg(*[pick(c, g).alias(f"{c}_{s}") for c in ("n", "mean", "var") for g, s in ((a, "a"), (b, "b"))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    d, se, df = F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1))
    t = t.select(*feature, d.alias("difference"), ((d - low) / se).alias("t_low"), ((d - high) / se).alias("t_high"), df.alias("df"))
    return t.withColumn("p", F.greatest(t_p(F.col("t_low"), F.col("df"), "greater"), t_p(F.col("t_high"), F.col("df"), "less")))


def kolmogorov_smirnov(rows: DataFrame, feature: Columns, group: str, value: str, a, b) -> DataFrame:
    """The largest distance of two empirical distributions, and p by Kolmogorov's limit."""
    v = clean(value)
    t = rows.where(v.isNotNull() & F.col(group).isin(a, b)).groupBy(*feature, v.alias("_v")).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    w = Window.partitionBy(*feature).orderBy("_v")
    whole = Window.partitionBy(*feature)
    t = t.select(*feature, F.sum("_a").over(whole).alias("na"), F.sum("_b").over(whole).alias("nb"), F.abs(F.sum("_a").over(w) / F.sum("_a").over(whole) - F.sum("_b").over(w) / F.sum("_b").over(whole)).alias("d"))
    s = t.groupBy(*feature).agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("d").alias("d"))
    x = F.col("d") ** 2 * (F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    terms = [(-1) ** (j - 1) * 2 * F.exp(-2.0 * j * j * x) for j in range(1, 101)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    p = F.when(x < 0.04, 1.0).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))  # below, the limit is 1 to twelve places
    return s.select(*feature, "na", "nb", "d", p.alias("p"))


def genomic_inflation(rows: DataFrame, feature: Columns, chi2: str) -> DataFrame:
    """Lambda: the median of chi-squares of one degree over the median expected."""
    mid = quantiles(rows, feature, chi2, [0.5])
    size = rows.groupBy(*feature).agg(F.count(chi2).alias("n"))
    both = null_safe_join(size, mid, feature, "left") if feature else size.crossJoin(F.broadcast(mid))  # one row
    return both.select(*feature, (F.col("q")[0] / 0.4549364231195724).alias("lambda"), "n")


def brier(rows: DataFrame, label: str, risk: str) -> DataFrame:
    """Brier's score, that of the mean rate, and the skill against it."""
    y, p = F.col(label).cast("double"), clean(risk)
    s = rows.where(y.isNotNull() & p.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) ** 2).alias("brier"), F.var_pop(y).alias("reference"))
    return s.select("n", "brier", "reference", F.when(F.col("reference") > 0, 1 - F.col("brier") / F.col("reference")).alias("skill"))


def cusum(rows: DataFrame, key: str, order: Columns, value: str, shift: float = 1.0, h: float = 5.0) -> DataFrame:
    """Two-sided running sums of standardised values, reset at zero, and whether one is beyond h. sigma is the mean moving
    range over 1.128. Series of fewer than three values, or that never move, are left out. A sum reset at zero is the plain running sum less its
    least value so far, so a window does it."""
    v = clean(value)
    all_ = Window.partitionBy("key")
    w = all_.orderBy("t")
    t = rows.where(v.isNotNull()).select(F.col(key).alias("key"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("t"), v.alias("v"))
    t = t.withColumn("center", F.avg("v").over(all_)).withColumn("_n", F.count(F.lit(1)).over(all_)).withColumn("_r", F.abs(F.col("v") - F.lag("v").over(w)))
    t = t.withColumn("std_dev", F.avg("_r").over(all_) / 1.128).where((F.col("std_dev") > 0) & (F.col("_n") >= 3))
    z = (F.col("v") - F.col("center")) / F.col("std_dev")
    for name, sign in (("up", 1), ("down", -1)):
        t = t.withColumn(f"_{name}", F.sum(sign * z - shift / 2).over(w))
        t = t.withColumn(name, F.col(f"_{name}") - F.least(F.min(f"_{name}").over(w), F.lit(0.0)))
    return t.select("key", "t", F.col("up").alias("cusum_pos"), (-F.col("down")).alias("cusum_neg"), "center", "std_dev", ((F.col("up") > h) | (F.col("down") > h)).alias("out_of_control"))


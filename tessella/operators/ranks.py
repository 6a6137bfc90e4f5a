"""Rank tests of ordered groups, blocks and scales, agreement of raters, and tests along a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.distributions import chi2_sf, f_sf, normal_sf
from tessella.operators.common import average_rank, clean, running
from tessella.operators.groups import _ranked
from tessella.operators.series import _numbered


def _both_sides(z):
    return F.least(2 * normal_sf(F.abs(z)), F.lit(1.0))


def jonckheere(rows: DataFrame, feature: list[str], group: str, value: str, order: list) -> DataFrame:
    """Jonckheere-Terpstra's J over groups in the given order (pairs in which the later group is larger, ties by half), z
    with the variance corrected for ties, and p. Works on counted distinct values, one column for each group."""
    v = clean(value)
    names = [f"_n{i}" for i in range(len(order))]
    tally = rows.where(v.isNotNull() & F.col(group).isin(order)).groupBy(*feature, v.alias("_v")).agg(*[F.count_if(F.col(group) == g).alias(c) for g, c in zip(order, names, strict=True)])
    upto = running(tally, ["_v"], feature, **{f"_u{i}": ("sum", F.col(c)) for i, c in enumerate(names)})
    j = sum(F.col(names[b]) * (F.col(f"_u{a}") - F.col(names[a]) / 2) for b in range(len(order)) for a in range(b))
    t = sum(F.col(c) for c in names).cast("double")
    sums = [F.sum(t * (t - 1) * (2 * t + 5)).alias("t1"), F.sum(t * (t - 1) * (t - 2)).alias("t2"), F.sum(t * (t - 1)).alias("t3")]
    s = upto.groupBy(*feature).agg(F.sum(j).alias("j"), *[F.sum(c).cast("double").alias(c) for c in names], *sums)
    size = [F.col(c) for c in names]
    n = sum(size)
    over_groups = lambda f: sum(f(m) for m in size)
    mean = (n * n - over_groups(lambda m: m * m)) / 4
    var = (n * (n - 1) * (2 * n + 5) - over_groups(lambda m: m * (m - 1) * (2 * m + 5)) - F.col("t1")) / 72
    var = var + F.when(n > 2, over_groups(lambda m: m * (m - 1) * (m - 2)) * F.col("t2") / (36 * n * (n - 1) * (n - 2))).otherwise(0.0)
    var = var + F.when(n > 1, over_groups(lambda m: m * (m - 1)) * F.col("t3") / (8 * n * (n - 1))).otherwise(0.0)
    out = s.select(*feature, "j", n.cast("long").alias("n"), mean.alias("_m"), var.alias("_v"))
    return out.withColumn("z", F.when(F.col("_v") > 0, (F.col("j") - F.col("_m")) / F.sqrt("_v"))).withColumn("p", _both_sides(F.col("z"))).drop("_m", "_v")


def ansari_bradley(rows: DataFrame, feature: list[str], group: str, value: str, a, b) -> DataFrame:
    """Sum of the scores min(rank, n + 1 - rank) of group a, with the normal approximation corrected for ties."""
    v = clean(value)
    two = rows.where(F.col(group).isin(a, b))
    tally = two.where(v.isNotNull()).groupBy(*feature, v.alias("_v")).agg(F.count_if(F.col(group) == a).alias("_a"))
    size = two.where(v.isNotNull()).groupBy(*feature).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col(group) == a).cast("double").alias("m"))
    t = _ranked(two, feature, value).join(tally, [*feature, "_v"]).join(size, feature)
    score = F.least("_rank", F.col("n") + 1 - F.col("_rank"))
    s = t.groupBy(*feature, "n", "m").agg(F.sum(F.col("_a") * score).alias("ab"), F.sum(F.col("_t") * score * score).alias("q"))
    n, m = F.col("n"), F.col("m")
    even = n % 2 == 0
    mean = F.when(even, m * (n + 2) / 4).otherwise(m * (n + 1) ** 2 / (4 * n))
    var = F.when(even, m * (n - m) * (16 * F.col("q") - n * (n + 2) ** 2) / (16 * n * (n - 1))).otherwise(m * (n - m) * (16 * n * F.col("q") - (n + 1) ** 4) / (16 * n * n * (n - 1)))
    z = F.when(var > 0, (F.col("ab") - mean) / F.sqrt(var))
    return s.select(*feature, "ab", z.alias("z")).withColumn("p", _both_sides(F.col("z")))


def quade(cells: DataFrame, block: str, treatment: str, value: str, treatments: int) -> DataFrame:
    """Quade's F over blocks that have all treatments: ranks within a block, weighted by the rank of the block's range."""
    t = cells.select(F.col(block).alias("b"), F.col(treatment).alias("t"), clean(value).alias("v")).where("v is not null")
    w = Window.partitionBy("b")
    r = F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("b", "v")) - 1) / 2
    one = t.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == treatments).withColumn("r", r)
    spans = average_rank(one.groupBy("b").agg((F.max("v") - F.min("v")).alias("range")), "range", "q")
    one = one.join(spans.select("b", "q"), "b")
    s = F.col("q") * (F.col("r") - (treatments + 1) / 2)
    per = one.groupBy("t").agg(F.sum(s).alias("s"), F.sum(s * s).alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    out = per.agg(F.sum("a").alias("a"), F.sum(F.col("s") ** 2 / F.col("b")).alias("between"), F.max("b").alias("b"))
    f = F.when(F.col("a") > F.col("between"), (F.col("b") - 1) * F.col("between") / (F.col("a") - F.col("between")))
    return out.select(f.alias("f"), F.lit(treatments - 1).cast("long").alias("df1"), ((F.col("b") - 1) * (treatments - 1)).cast("long").alias("df2")).withColumn("p", f_sf(F.col("f"), F.col("df1"), F.col("df2")))


def krippendorff(rows: DataFrame, unit: str, value: str, level: str = "nominal") -> DataFrame:
    """Krippendorff's alpha of values that raters gave to units; units with one value are left out. `level`: nominal or
    interval. From sums by unit and counts by value."""
    v = F.col(value) if level == "nominal" else clean(value)
    t = rows.where(v.isNotNull()).groupBy(F.col(unit).alias("u"), v.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    x = F.col("v").cast("double") if level == "interval" else F.lit(0.0)
    sums = [F.sum("c").alias("m"), F.sum(F.col("c") ** 2).alias("c2"), F.sum(F.col("c") * x).alias("s"), F.sum(F.col("c") * x * x).alias("s2")]
    apart = F.col("m") ** 2 - F.col("c2") if level == "nominal" else 2 * (F.col("m") * F.col("s2") - F.col("s") ** 2)
    units = t.groupBy("u").agg(*sums).where("m > 1")
    inner = units.agg(F.sum(apart / (F.col("m") - 1)).alias("inner"), F.count(F.lit(1)).alias("units"))
    used = t.join(units.select("u"), "u").groupBy("v").agg(F.sum("c").alias("c"))
    whole = used.agg(*sums).select("m", apart.alias("outer")).crossJoin(inner)  # one row each
    return whole.select(F.when(F.col("outer") > 0, 1 - (F.col("m") - 1) * F.col("inner") / F.col("outer")).alias("alpha"), "units", F.col("m").cast("long").alias("n"))


def intraclass(cells: DataFrame, subject: str, rater: str, value: str, raters: int) -> DataFrame:
    """Intraclass correlations over subjects that all raters judged: one-way, agreement and consistency, of one rater and
    of the raters' mean."""
    t = cells.select(F.col(subject).alias("s"), F.col(rater).alias("r"), clean(value).alias("v")).where("v is not null")
    full = t.join(t.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == raters), "s", "left_semi")
    k = float(raters)
    rows_ = full.groupBy("s").agg(F.avg("v").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.var_pop("m").alias("vr"))
    columns = full.groupBy("r").agg(F.avg("v").alias("m")).agg(F.var_pop("m").alias("vc"))
    one = full.agg(F.var_pop("v").alias("vt")).crossJoin(rows_).crossJoin(columns)  # one row each
    n = F.col("n")
    ssr, ssc, sst = n * k * F.col("vr"), n * k * F.col("vc"), n * k * F.col("vt")
    one = one.select(n.cast("long").alias("n"), (ssr / (n - 1)).alias("r"), (ssc / (k - 1)).alias("c"), ((sst - ssr - ssc) / ((n - 1) * (k - 1))).alias("e"), ((sst - ssr) / (n * (k - 1))).alias("w")).where("n > 1")
    r, c, e, w = (F.col(x) for x in "rcew")
    return one.select(
        "n", ((r - w) / (r + (k - 1) * w)).alias("oneway_single"), ((r - w) / r).alias("oneway_average"),
        ((r - e) / (r + (k - 1) * e + k / F.col("n") * (c - e))).alias("agreement_single"), ((r - e) / (r + (c - e) / F.col("n"))).alias("agreement_average"),
        ((r - e) / (r + (k - 1) * e)).alias("consistency_single"), ((r - e) / r).alias("consistency_average"),
    )


def reclassification(rows: DataFrame, label: str, old: str, new: str) -> DataFrame:
    """Integrated discrimination improvement and the category-free net reclassification improvement of `new` over `old`."""
    d = clean(new) - clean(old)
    t = rows.where(d.isNotNull() & F.col(label).isNotNull()).select((F.col(label) == 1).alias("y"), d.alias("d"))
    of = lambda f, y: F.avg(F.when(F.col("y") == y, f))
    up = F.signum("d")
    return t.agg((of(F.col("d"), True) - of(F.col("d"), False)).alias("idi"), of(up, True).alias("nri_events"), (-of(up, False)).alias("nri_others"), F.count(F.lit(1)).alias("n")).withColumn("nri", F.col("nri_events") + F.col("nri_others"))


def morisita(cells: DataFrame, feature: str, value: str, units: int) -> DataFrame:
    """Morisita's index of dispersion of counts over `units` places, with the chi-square p of clumping."""
    v = clean(value)
    s = cells.groupBy(F.col(feature).alias("key")).agg(F.sum(v).alias("s"), F.sum(v * v).alias("s2"))
    chi = F.col("s2") * units / F.col("s") - F.col("s")
    index = F.when(F.col("s") > 1, units * (F.col("s2") - F.col("s")) / (F.col("s") ** 2 - F.col("s")))
    return s.where("s > 0").select("key", index.alias("index"), chi.alias("chi2"), chi2_sf(chi, F.lit(units - 1)).alias("p"))


def partial_acf(acf: DataFrame, lags: int) -> DataFrame:
    """Partial autocorrelations by key and lag from autocorrelations at lags 1 to `lags`, by Durbin and Levinson's recursion."""
    r = acf.groupBy("key").agg(*[F.max(F.when(F.col("lag") == k, F.col("acf"))).alias(f"r{k}") for k in range(1, lags + 1)])
    for k in range(1, lags + 1):
        above = F.col(f"r{k}") - sum((F.col(f"f{k - 1}_{j}") * F.col(f"r{k - j}") for j in range(1, k)), F.lit(0.0))
        below = 1 - sum((F.col(f"f{k - 1}_{j}") * F.col(f"r{j}") for j in range(1, k)), F.lit(0.0))
        r = r.withColumn(f"f{k}_{k}", F.when(F.abs(below) > 1e-12, above / below))
        r = r.withColumns({f"f{k}_{j}": F.col(f"f{k - 1}_{j}") - F.col(f"f{k}_{k}") * F.col(f"f{k - 1}_{k - j}") for j in range(1, k)})
    return r.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"f{k}_{k}").alias("pacf")) for k in range(1, lags + 1)])).alias("p")).select("key", "p.*")


def arch_lm(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Engle's test at one lag: rows times the squared correlation of squared deviations with those before."""
    w = Window.partitionBy("key")
    s = _numbered(rows, key, order, value).withColumn("e", (F.col("v") - F.avg("v").over(w)) ** 2)
    s = s.withColumn("p", F.lag("e").over(w.orderBy("t"))).where("p is not null")
    chi = F.count(F.lit(1)) * F.corr("e", "p") ** 2
    return s.groupBy("key").agg(chi.alias("chi2"), F.count(F.lit(1)).alias("n")).withColumn("p", chi2_sf(F.col("chi2"), F.lit(1)))


def pettitt(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Pettitt's change point: the first largest |U|, where it is, and its approximate p."""
    s = average_rank(_numbered(rows, key, order, value), "v", "r", ["key"])
    size = s.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    u = running(s.join(size, "key"), ["t"], ["key"], _s=("sum", F.col("r")))
    u = u.withColumn("u", F.abs(2 * F.col("_s") - F.col("t") * (F.col("n") + 1)))
    best = u.groupBy("key", "n").agg(F.max(F.struct("u", (-F.col("t")).alias("t"))).alias("m"))
    n, k = F.col("n"), F.col("m.u")
    return best.select("key", k.alias("k"), (-F.col("m.t")).cast("long").alias("at"), F.least(2 * F.exp(-6 * k * k / (n**3 + n * n)), F.lit(1.0)).alias("p"))

"""Association in contingency tables. A table is counts by (row, column); inputs are the raw rows, counted first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.distributions import chi2_sf


def counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Complete table of counts (absent pairs 0); rows with a missing side are left out. Bounded by the numbers of labels."""
    full = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    seen = full.groupBy(F.col(a).alias("r"), F.col(b).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    grid = seen.select("r").distinct().crossJoin(seen.select("c").distinct())  # labels, not rows
    return grid.join(seen, ["r", "c"], "left").na.fill(0, ["n"])


def _expected(table: DataFrame) -> DataFrame:
    rows, cols = table.groupBy("r").agg(F.sum("n").alias("nr")), table.groupBy("c").agg(F.sum("n").alias("nc"))
    total = table.agg(F.sum("n").alias("total"))
    return table.join(rows, "r").join(cols, "c").crossJoin(total).withColumn("e", F.col("nr") * F.col("nc") / F.col("total"))


def association(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, g (likelihood ratio), df, the p of both, cramer_v, phi, contingency coefficient, n."""
    t = _expected(counts(rows, a, b)).where("e > 0")
    chi = F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e"))
    g = 2 * F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("e"))).otherwise(0.0))
    out = t.agg(chi.alias("chi2"), g.alias("g"), F.sum("n").alias("n"), F.count_distinct("r").alias("nr"), F.count_distinct("c").alias("nc"))
    low = F.least("nr", "nc") - 1
    df = (F.col("nr") - 1) * (F.col("nc") - 1)
    return out.select("chi2", "g", df.alias("df"), chi2_sf(F.col("chi2"), df).alias("p"), chi2_sf(F.col("g"), df).alias("p_g"), F.sqrt(F.col("chi2") / (F.col("n") * low)).alias("cramer_v"), F.sqrt(F.col("chi2") / F.col("n")).alias("phi"), F.sqrt(F.col("chi2") / (F.col("chi2") + F.col("n"))).alias("contingency"), "n")


def theil_u(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies in nats; the share of each side's entropy that the other explains, and the symmetric one."""
    t = _expected(counts(rows, a, b))
    plogp = lambda n: F.when(n > 0, -(n / F.col("total")) * F.log(n / F.col("total"))).otherwise(0.0)
    hr = t.select("r", "nr", "total").distinct().agg(F.sum(plogp(F.col("nr"))).alias("h_row"))
    hc = t.select("c", "nc", "total").distinct().agg(F.sum(plogp(F.col("nc"))).alias("h_col"))
    h = t.agg(F.sum(plogp(F.col("n"))).alias("h_joint"))
    mi = F.col("h_row") + F.col("h_col") - F.col("h_joint")
    return hr.crossJoin(hc).crossJoin(h).select("h_row", "h_col", "h_joint", (mi / F.col("h_row")).alias("u_row"), (mi / F.col("h_col")).alias("u_col"), (2 * mi / (F.col("h_row") + F.col("h_col"))).alias("u_symmetric"))


def two_by_two(rows: DataFrame, exposed: Column, case: Column) -> DataFrame:
    """a: exposed cases, b: exposed others, c: unexposed cases, d: the rest."""
    pick = lambda x, y: F.count_if(x & y)
    return rows.agg(pick(exposed, case).alias("a"), pick(exposed, ~case).alias("b"), pick(~exposed, case).alias("c"), pick(~exposed, ~case).alias("d"))


def odds_ratio(table: DataFrame, correction: str = "haldane", z: float = 1.959963984540054) -> DataFrame:
    """Woolf interval; haldane adds a half to every cell."""
    add = 0.5 if correction == "haldane" else 0.0
    a, b, c, d = (F.col(x) + add for x in "abcd")
    log, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return table.select((a * d / (b * c)).alias("odds_ratio"), F.exp(log - z * se).alias("low"), F.exp(log + z * se).alias("high"), se.alias("se"))


def risk_ratio(table: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    p, q = a / (a + b), c / (c + d)
    se = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    return table.select((p / q).alias("risk_ratio"), F.exp(F.log(p / q) - z * se).alias("low"), F.exp(F.log(p / q) + z * se).alias("high"), (p - q).alias("risk_difference"))


def cohens_h(table: DataFrame) -> DataFrame:
    p, q = F.col("a") / (F.col("a") + F.col("b")), F.col("c") / (F.col("c") + F.col("d"))
    return table.select((2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))).alias("h"))


def mcnemar(table: DataFrame) -> DataFrame:
    """Statistic with and without continuity correction, from the discordant cells."""
    b, c = F.col("b"), F.col("c")
    some = b + c > 0
    out = table.select("b", "c", F.when(some, (b - c) ** 2 / (b + c)).otherwise(0.0).alias("statistic"), F.when(some, F.greatest(F.abs(b - c) - 1, F.lit(0)) ** 2 / (b + c)).otherwise(0.0).alias("corrected"))
    return out.withColumn("p", chi2_sf(F.col("statistic"), F.lit(1))).withColumn("p_corrected", chi2_sf(F.col("corrected"), F.lit(1)))


def kappa(rows: DataFrame, a: str, b: str, weights: str = "none") -> DataFrame:
    """Cohen's kappa for two raters with numeric categories; linear or quadratic disagreement weights."""
    t = _expected(counts(rows, a, b))
    gap = F.abs(F.col("r") - F.col("c"))
    w = {"none": F.when(gap > 0, 1.0).otherwise(0.0), "linear": gap.cast("double"), "quadratic": (gap * gap).cast("double")}[weights]
    return t.agg((1 - F.sum(w * F.col("n")) / F.sum(w * F.col("e"))).alias("kappa"), (F.sum(F.when(gap == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))


def chance_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement coefficients of two raters: Brennan-Prediger, Gwet's AC1, Scott's pi."""
    t = _expected(counts(rows, a, b))
    q = t.agg(F.count_distinct("r", "c")).first()[0]
    cats = counts(rows, a, b).select("r").union(counts(rows, a, b).select("c")).distinct().count() if q else 0
    po = t.agg((F.sum(F.when(F.col("r") == F.col("c"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"))
    total = F.max("total")
    share = t.select(F.col("r").alias("k"), F.col("n"), "total").unionByName(t.select(F.col("c").alias("k"), "n", "total")).groupBy("k").agg((F.sum("n") / (2 * total)).alias("pi"))
    pe = share.agg(F.sum(F.col("pi") ** 2).alias("scott"), (F.sum(F.col("pi") * (1 - F.col("pi"))) / max(cats - 1, 1)).alias("gwet"))
    of = lambda e: (F.col("po") - e) / (1 - e)
    return po.crossJoin(pe).select("po", of(F.lit(1 / max(cats, 1))).alias("brennan_prediger"), of(F.col("gwet")).alias("gwet_ac1"), of(F.col("scott")).alias("scott_pi"))


def ordinal(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Goodman-Kruskal gamma, Somers' D both ways and Kendall's tau-b of two ordered columns: pairs of table cells, not of rows."""
    t = counts(rows, a, b).where("n > 0")
    x, y = t.alias("x"), t.alias("y")
    m = F.col("x.n") * F.col("y.n")
    pairs = x.join(y, F.col("x.r") < F.col("y.r"))  # labels only
    cd = pairs.agg(F.coalesce(F.sum(F.when(F.col("x.c") < F.col("y.c"), m)), F.lit(0)).alias("con"), F.coalesce(F.sum(F.when(F.col("x.c") > F.col("y.c"), m)), F.lit(0)).alias("dis"))
    pairs_in = lambda k: t.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t_{k}"), (F.sum("n") * (F.sum("n") - 1) / 2).alias(f"all_{k}"))
    out = cd.crossJoin(pairs_in("r")).crossJoin(pairs_in("c"))
    s = F.col("con") - F.col("dis")
    free_r, free_c = F.col("all_r") - F.col("t_r"), F.col("all_c") - F.col("t_c")
    return out.select(F.col("con").alias("concordant"), F.col("dis").alias("discordant"), (s / (F.col("con") + F.col("dis"))).alias("gamma"), (s / free_r).alias("d_column"), (s / free_c).alias("d_row"), (s / F.sqrt(free_r * free_c)).alias("tau_b"))


def clustering_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, mutual information and its normalised form, of two labelings."""
    t = _expected(counts(rows, a, b))
    two = lambda n: n * (n - 1) / 2
    cells = t.agg(F.sum(two(F.col("n"))).alias("ij"), F.max("total").alias("n"), F.sum(F.when(F.col("n") > 0, F.col("n") / F.col("total") * F.log(F.col("n") / F.col("e"))).otherwise(0.0)).alias("mi"))
    plogp = lambda n: -(n / F.col("total")) * F.log(n / F.col("total"))
    r = t.select("r", "nr", "total").distinct().agg(F.sum(two(F.col("nr"))).alias("i"), F.sum(plogp(F.col("nr"))).alias("hr"))
    c = t.select("c", "nc", "total").distinct().agg(F.sum(two(F.col("nc"))).alias("j"), F.sum(plogp(F.col("nc"))).alias("hc"))
    e = F.col("i") * F.col("j") / two(F.col("n"))
    return cells.crossJoin(r).crossJoin(c).select(((F.col("ij") - e) / ((F.col("i") + F.col("j")) / 2 - e)).alias("ari"), "mi", (2 * F.col("mi") / (F.col("hr") + F.col("hc"))).alias("nmi"))


def clustering_scores(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Of labelings a (true) and b: homogeneity, completeness and V-measure, variation of information (nats), Fowlkes and
    Mallows' index, the adjusted Rand index and ordered pairs of rows by whether each labeling holds them together."""
    t = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    side = lambda c: t.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    xlogx = lambda c: F.sum(F.col(c) * F.log(c))
    both = t.agg(F.sum("n").alias("m"), F.sum(F.col("n") ** 2).alias("n2"), xlogx("n").alias("ln"))
    for c in ("a", "b"):
        both = both.crossJoin(side(c).agg(F.sum(F.col(f"n_{c}") ** 2).alias(f"{c}2"), xlogx(f"n_{c}").alias(f"l{c}")))  # one row each
    m, n2, a2, b2 = (F.col(c) for c in ("m", "n2", "a2", "b2"))
    given_b, given_a = (F.col("lb") - F.col("ln")) / m, (F.col("la") - F.col("ln")) / m
    entropy_a, entropy_b = F.log(m) - F.col("la") / m, F.log(m) - F.col("lb") / m
    h, c = F.when(entropy_a > 0, 1 - given_b / entropy_a).otherwise(1.0), F.when(entropy_b > 0, 1 - given_a / entropy_b).otherwise(1.0)
    chance, top = (a2 - m) * (b2 - m) / (2 * m * (m - 1)), (a2 + b2 - 2 * m) / 4
    return both.where("m > 1").select(
        h.alias("homogeneity"), c.alias("completeness"), F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0).alias("v_measure"), (given_a + given_b).alias("variation_of_information"),
        F.when((a2 > m) & (b2 > m), (n2 - m) / F.sqrt((a2 - m) * (b2 - m))).otherwise(0.0).alias("fowlkes_mallows"), F.when(top != chance, ((n2 - m) / 2 - chance) / (top - chance)).otherwise(1.0).alias("adjusted_rand"),
        (m * m - a2 - b2 + n2).cast("long").alias("apart_apart"), (b2 - n2).cast("long").alias("apart_together"), (a2 - n2).cast("long").alias("together_apart"), (n2 - m).cast("long").alias("together_together"),
    )


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows by actual and predicted label (0 or 1), all four cells."""
    a, p = F.col(actual).cast("int"), F.col(predicted).cast("int")
    cells = [F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.count_if((a == i) & (p == j)).alias("n")) for i in (0, 1) for j in (0, 1)]
    return rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")

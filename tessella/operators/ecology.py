"""Diversity of samples and dissimilarity between them, from long counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import clean


def diversity(cells: DataFrame, sample: str, value: str = "value") -> DataFrame:
    """Richness, Shannon (nats), Simpson (1 - sum p²), inverse Simpson, evenness (missing for one species), Gini, Berger-Parker."""
    v = clean(value)
    t = cells.where(v > 0).withColumn("_v", v).withColumn("_n", F.sum("_v").over(Window.partitionBy(sample)))
    p = F.col("_v") / F.col("_n")
    i = F.row_number().over(Window.partitionBy(sample).orderBy("_v"))
    s = t.withColumn("_i", i).groupBy(sample).agg(F.count(F.lit(1)).alias("richness"), F.sum(-p * F.log(p)).alias("shannon"), F.sum(p * p).alias("_d"), F.max(p).alias("berger_parker"), F.sum(F.col("_i") * F.col("_v")).alias("_iv"), F.max("_n").alias("total"))
    r = F.col("richness")
    return s.select(sample, "richness", "total", "shannon", (1 - F.col("_d")).alias("simpson"), (1 / F.col("_d")).alias("inverse_simpson"), F.when(r > 1, F.col("shannon") / F.log(r)).alias("evenness"), (2 * F.col("_iv") / (r * F.col("total")) - (r + 1) / r).alias("gini"), "berger_parker")


def hill_family(cells: DataFrame, sample: str, value: str = "value", q: float = 2.0) -> DataFrame:
    """Renyi and Tsallis entropies and the Hill number of order q (not 1)."""
    v = clean(value)
    t = cells.where(v > 0).withColumn("_p", v / F.sum(v).over(Window.partitionBy(sample)))
    s = t.groupBy(sample).agg(F.sum(F.pow("_p", F.lit(q))).alias("_s"))
    return s.select(sample, (F.log("_s") / (1 - q)).alias("renyi"), ((1 - F.col("_s")) / (q - 1)).alias("tsallis"), F.pow("_s", F.lit(1 / (1 - q))).alias("hill"))


def chao1(cells: DataFrame, sample: str, value: str = "value") -> DataFrame:
    """Bias-corrected Chao1 with singletons and doubletons, and Good's coverage."""
    v = clean(value)
    s = cells.where(v > 0).groupBy(sample).agg(F.count(F.lit(1)).alias("observed"), F.count_if(v == 1).alias("f1"), F.count_if(v == 2).alias("f2"), F.sum(v).alias("n"))
    return s.select(sample, "observed", "f1", "f2", (F.col("observed") + F.col("f1") * (F.col("f1") - 1) / (2 * (F.col("f2") + 1))).alias("chao1"), (1 - F.col("f1") / F.col("n")).alias("coverage"))


def entropies(cells: DataFrame, sample: str, value: str = "value", orders: tuple[float, ...] = (0, 0.5, 1, 2)) -> DataFrame:
    """Rényi's and Tsallis' entropies and Hill's number of each sample, by order."""
    v = clean(value)
    t = cells.where(v > 0).select(F.col(sample).alias("key"), v.alias("v"))
    whole = t.groupBy("key").agg(F.sum("v").alias("total"))
    p = F.col("v") / F.col("total")
    sums = t.join(whole, "key").groupBy("key").agg(*[(F.sum(-p * F.ln(p)) if q == 1 else F.sum(F.pow(p, F.lit(float(q))))).alias(f"s{i}") for i, q in enumerate(orders)])
    rows = []
    for i, q in enumerate(orders):
        s = F.col(f"s{i}")
        renyi = s if q == 1 else F.ln(s) / (1 - q)
        rows.append(F.struct(F.lit(float(q)).alias("order"), renyi.alias("renyi"), (s if q == 1 else (1 - s) / (q - 1)).alias("tsallis"), F.exp(renyi).alias("hill")))
    return sums.select("key", F.explode(F.array(*rows)).alias("e")).select("key", "e.*")


def species_pool(cells: DataFrame, sample: str, taxon: str, value: str = "value") -> DataFrame:
    """Richness of the whole pool from incidences: seen, Chao (small-sample form), first and second jackknife, bootstrap."""
    v = clean(value)
    n = cells.select(sample).distinct().agg(F.count(F.lit(1)).cast("double").alias("n"))
    f = cells.where(v > 0).groupBy(taxon).agg(F.count_distinct(sample).alias("f")).crossJoin(n)  # one number
    f = f.groupBy("n").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("f") == 1).alias("a1"), F.count_if(F.col("f") == 2).alias("a2"), F.sum(F.pow(1 - F.col("f") / F.col("n"), F.col("n"))).alias("unseen"))
    a1, a2, n, s = F.col("a1"), F.col("a2"), F.col("n"), F.col("seen")
    chao = s + F.when(a2 > 0, a1 * a1 / (2 * a2)).otherwise(a1 * (a1 - 1) / 2) * (n - 1) / n
    return f.select("seen", chao.alias("chao"), (s + a1 * (n - 1) / n).alias("jack1"), (s + a1 * (2 * n - 3) / n - a2 * (n - 2) ** 2 / (n * (n - 1))).alias("jack2"), (s + F.col("unseen")).alias("boot"))

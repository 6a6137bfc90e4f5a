"""Genotypes as long dosages: variant, sample, dosage (0 to ploidy, missing allowed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean


def allele_stats(cells: DataFrame, variant: str, dosage: str, ploidy: int = 2) -> DataFrame:
    """n called, missing rate, allele frequency, minor allele frequency, genotype counts, expected and observed heterozygosity,
    the inbreeding coefficient and the Hardy-Weinberg chi-square."""
    d = clean(dosage)
    t = cells.groupBy(variant).agg(F.count(d).alias("n"), F.avg(d.isNull().cast("double")).alias("missing"), F.sum(d).alias("s"), *[F.count_if(d == g).alias(f"n{g}") for g in range(3)])
    p = F.col("s") / (ploidy * F.col("n"))
    t = t.withColumn("p", p)
    n, p = F.col("n"), F.col("p")
    he, ho = 2 * p * (1 - p), F.col("n1") / n
    e0, e1, e2 = n * (1 - p) ** 2, n * he, n * p**2
    chi = sum(((F.col(f"n{g}") - e) ** 2 / e for g, e in enumerate((e0, e1, e2))), F.lit(0.0))
    return t.select(variant, "n", "missing", "p", F.least(p, 1 - p).alias("maf"), "n0", "n1", "n2", he.alias("expected_het"), ho.alias("observed_het"), F.when(he > 0, 1 - ho / he).alias("inbreeding"), F.when(he > 0, chi).alias("hwe_chi2"))


def maf_filter(cells: DataFrame, variant: str, dosage: str, threshold: float = 0.01, ploidy: int = 2) -> DataFrame:
    keep = allele_stats(cells, variant, dosage, ploidy).where(F.col("maf") >= threshold)
    return cells.join(keep.select(variant), variant, "left_semi")


def ld(cells: DataFrame, variant: str, sample: str, dosage: str, window: int) -> DataFrame:
    """r² of pairs of variants (numbers) at most `window` apart, over samples called in both."""
    d = cells.select(F.col(variant).alias("v"), F.col(sample).alias("s"), clean(dosage).alias("d")).where("d is not null")
    near = d.withColumn("w", F.explode(F.sequence(F.col("v") + 1, F.col("v") + window)))
    both = near.alias("a").join(d.alias("b"), (F.col("a.w") == F.col("b.v")) & (F.col("a.s") == F.col("b.s")))
    r = F.when((F.var_pop("a.d") > 0) & (F.var_pop("b.d") > 0), F.corr("a.d", "b.d"))
    return both.groupBy(F.col("a.v").alias("a"), F.col("b.v").alias("b")).agg(F.count(F.lit(1)).alias("n"), (r * r).alias("r2"))


def polygenic_score(cells: DataFrame, weights: DataFrame, variant: str, sample: str, dosage: str, weight: str) -> DataFrame:
    return cells.join(weights.select(variant, weight), variant).groupBy(sample).agg(F.sum(clean(dosage) * F.col(weight)).alias("score"), F.count(clean(dosage)).alias("n"))


def association_score(cells: DataFrame, trait: DataFrame, variant: str, sample: str, dosage: str, y: str) -> DataFrame:
    """Least squares of a trait on the dosage, variant by variant."""
    from tessella.operators.agreement import linear_fit

    return linear_fit(cells.join(trait.select(sample, y), sample), dosage, y, [variant])

"""Population genetics over long dosages with a population for each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean


def frequencies(cells: DataFrame, groups: DataFrame, variant: str, sample: str, dosage: str, group: str, ploidy: int = 2) -> DataFrame:
    """Allele copies n and frequency p by variant and population."""
    d = clean(dosage)
    return cells.join(groups.select(sample, group), sample).where(d.isNotNull()).groupBy(variant, group).agg((F.count(F.lit(1)) * ploidy).alias("n"), (F.sum(d) / (F.count(F.lit(1)) * ploidy)).alias("p"))


def fst(freq: DataFrame, variant: str, group: str, a, b) -> DataFrame:
    """Hudson's estimator by variant, with dxy; numerator and denominator so that ratios of sums can be taken."""
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    t = freq.groupBy(variant).agg(pick("p", a).alias("p"), pick("p", b).alias("q"), pick("n", a).alias("n"), pick("n", b).alias("m")).where("n > 1 and m > 1")
    p, q = F.col("p"), F.col("q")
    num = (p - q) ** 2 - p * (1 - p) / (F.col("n") - 1) - q * (1 - q) / (F.col("m") - 1)
    den = p * (1 - q) + q * (1 - p)
    return t.select(variant, num.alias("numerator"), den.alias("dxy"), F.when(den > 0, num / den).alias("fst"))


def diversity(cells: DataFrame, variant: str, dosage: str, ploidy: int = 2) -> DataFrame:
    """Nucleotide diversity (sum of site heterozygosities), segregating sites, Watterson's theta and Tajima's D; n is the largest number of copies."""
    d = clean(dosage)
    s = cells.where(d.isNotNull()).groupBy(variant).agg((F.count(F.lit(1)) * ploidy).cast("double").alias("n"), F.sum(d).alias("k"))
    site = s.select("n", (2 * F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") * (F.col("n") - 1))).alias("pi"), ((F.col("k") > 0) & (F.col("k") < F.col("n"))).cast("long").alias("seg"))
    t = site.agg(F.sum("pi").alias("pi"), F.sum("seg").alias("S"), F.max("n").cast("long").alias("n"))
    sums = lambda p: F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n") - 1), F.lit(0.0), lambda a, i: a + 1 / F.pow(i, F.lit(p)))
    t = t.withColumn("a1", sums(1)).withColumn("a2", sums(2))
    n = F.col("n").cast("double")
    c1 = (n + 1) / (3 * (n - 1)) - 1 / F.col("a1")
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (F.col("a1") * n) + F.col("a2") / F.col("a1") ** 2
    e1, e2 = c1 / F.col("a1"), c2 / (F.col("a1") ** 2 + F.col("a2"))
    s = F.col("S")
    return t.select("pi", s.alias("segregating"), (s / F.col("a1")).alias("theta"), ((F.col("pi") - s / F.col("a1")) / F.sqrt(e1 * s + e2 * s * (s - 1))).alias("tajimas_d"), "n")


def site_frequency_spectrum(cells: DataFrame, variant: str, dosage: str, folded: bool = True, ploidy: int = 2) -> DataFrame:
    d = clean(dosage)
    s = cells.where(d.isNotNull()).groupBy(variant).agg((F.count(F.lit(1)) * ploidy).alias("n"), F.sum(d).cast("long").alias("k"))
    k = F.least("k", F.col("n") - F.col("k")) if folded else F.col("k")
    return s.groupBy(k.alias("copies")).agg(F.count(F.lit(1)).alias("sites"))


def relationship(cells: DataFrame, variant: str, sample: str, dosage: str, ploidy: int = 2, max_positions: int | None = None) -> DataFrame:
    """Genomic relationships of pairs of samples (a <= b): mean of products of standardised dosages over variants that vary."""
    if max_positions is not None and cells.select(sample).distinct().count() > max_positions:
        raise ValueError(f"more than {max_positions} samples")
    d = clean(dosage)
    f = cells.where(d.isNotNull()).groupBy(variant).agg((F.avg(d) / ploidy).alias("p")).where("p > 0 and p < 1")
    z = cells.where(d.isNotNull()).join(f, variant).select(F.col(variant).alias("v"), F.col(sample).alias("s"), ((d - ploidy * F.col("p")) / F.sqrt(ploidy * F.col("p") * (1 - F.col("p")))).alias("z"))
    return z.alias("a").join(z.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("a.s") <= F.col("b.s"))).groupBy(F.col("a.s").alias("a"), F.col("b.s").alias("b")).agg(F.avg(F.col("a.z") * F.col("b.z")).alias("relationship"), F.count(F.lit(1)).alias("n"))


def ld_decay(pairs: DataFrame, width: int) -> DataFrame:
    """Mean r² by distance bin, from pairs (a, b, r2) of numbered variants."""
    return pairs.groupBy(F.floor((F.col("b") - F.col("a")) / width).alias("bin")).agg(F.count("r2").alias("n"), F.avg("r2").alias("mean_r2"))

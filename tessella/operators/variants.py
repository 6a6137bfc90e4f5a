"""Quality of genotype calls: long rows (variant, sample, dosage), a missing call a null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.operators.common import clean
from tessella.session import ship


def site_missingness(cells: DataFrame, variant: str, dosage: str) -> DataFrame:
    d = clean(dosage)
    return cells.groupBy(variant).agg(F.count(d).alias("called"), F.count_if(d.isNull()).alias("missing"), (F.count(d) / F.count(F.lit(1))).alias("call_rate"))


def sample_stats(cells: DataFrame, sample: str, dosage: str) -> DataFrame:
    """Calls by genotype, the call rate, and heterozygous over homozygous alternate calls."""
    d = clean(dosage)
    t = cells.groupBy(sample).agg(F.count(F.lit(1)).alias("sites"), F.count(d).alias("called"), *[F.count_if(d == g).alias(n) for g, n in enumerate(("hom_ref", "het", "hom_alt"))])
    return t.select(sample, "sites", "called", (F.col("called") / F.col("sites")).alias("call_rate"), "hom_ref", "het", "hom_alt", F.when(F.col("hom_alt") > 0, F.col("het") / F.col("hom_alt")).alias("het_hom_ratio"))


def genotype_filter(cells: DataFrame, variant: str, dosage: str, min_call_rate: float = 0.9, min_maf: float = 0.0) -> DataFrame:
    """The cells of variants with enough calls and a frequent enough minor allele; none left is an error of the data."""
    d = clean(dosage)
    p = F.sum(d) / (2 * F.count(d))
    keep = cells.groupBy(variant).agg((F.count(d) / F.count(F.lit(1))).alias("rate"), F.least(p, 1 - p).alias("maf")).where((F.col("rate") >= min_call_rate) & (F.col("maf") >= min_maf))
    return cells.join(keep.select(variant), variant, "left_semi")


@F.pandas_udf(DoubleType())
def _hwe(ref: pd.Series, het: pd.Series, alt: pd.Series) -> pd.Series:
    """Of one site: the joint probability of all heterozygote counts that are not likelier than the one seen, alleles given."""

    def one(a: float, h: float, b: float):
        if pd.isna(a) or a + h + b == 0:
            return None
        n, minor = a + h + b, int(2 * min(a, b) + h)
        hets = np.arange(minor % 2, minor + 1, 2)
        few = (minor - hets) / 2
        logs = np.array([hh * math.log(2) - math.lgamma(hh + 1) - math.lgamma(f + 1) - math.lgamma(n - hh - f + 1) for hh, f in zip(hets, few, strict=True)])
        p = np.exp(logs - logs.max())
        p /= p.sum()
        return float(min(1.0, p[p <= p[int(h) // 2] * (1 + 1e-7)].sum()))

    return pd.Series([one(*x) for x in zip(ref, het, alt, strict=True)], dtype="float64")


def hwe_exact(ref: Column, het: Column, alt: Column) -> Column:
    return _hwe(*(c.cast("double") for c in (ref, het, alt)))


def hwe_test(cells: DataFrame, variant: str, dosage: str) -> DataFrame:
    """Genotype counts and the exact p of Hardy and Weinberg's proportions."""
    ship(cells.sparkSession)
    d = clean(dosage)
    t = cells.groupBy(variant).agg(*[F.count_if(d == g).alias(n) for g, n in enumerate(("hom_ref", "het", "hom_alt"))])
    return t.withColumn("p", hwe_exact(F.col("hom_ref"), F.col("het"), F.col("hom_alt")))


def hwe_filter(cells: DataFrame, variant: str, dosage: str, threshold: float = 1e-6) -> DataFrame:
    keep = hwe_test(cells, variant, dosage).where(F.col("p") >= threshold)
    return cells.join(keep.select(variant), variant, "left_semi")


def windowed_diversity(cells: DataFrame, variant: str, dosage: str, size: int) -> DataFrame:
    """By window of `size` positions (variants are numbers): nucleotide diversity a position, segregating sites and
    Watterson's theta with the largest number of allele copies."""
    d = clean(dosage)
    s = cells.where(d.isNotNull()).groupBy(variant).agg((2.0 * F.count(F.lit(1))).alias("n"), F.sum(d).alias("k")).where("n > 1")
    n, k = F.col("n"), F.col("k")
    t = s.groupBy(F.floor(F.col(variant) / size).alias("window")).agg((F.sum(2 * k * (n - k) / (n * (n - 1))) / size).alias("pi"), F.count_if((k > 0) & (k < n)).alias("segregating"), F.max("n").alias("copies"))
    a1 = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long") - 1), F.lit(0.0), lambda a, i: a + 1 / i)
    return t.select("window", "pi", "segregating", (F.col("segregating") / a1 / size).alias("theta"))


def population_distance(freq: DataFrame, variant: str, group: str, a, b) -> DataFrame:
    """Mean dxy of two populations and the ratio of sums of Hudson's Fst, from `populations.frequencies`."""
    from tessella.operators.populations import fst

    return fst(freq, variant, group, a, b).agg(F.count(F.lit(1)).alias("sites"), F.avg("dxy").alias("dxy"), (F.sum("numerator") / F.sum("dxy")).alias("fst"))

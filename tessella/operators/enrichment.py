"""Term enrichment of gene lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.distributions import hypergeometric_sf
from tessella.operators.common import materialized
from tessella.session import ship


def overlap_counts(hits: DataFrame, universe: DataFrame, gene: str, term: str, min_size: int = 1, genes: DataFrame | None = None) -> DataFrame:
    """For each term: hits with it, its size, hits drawn at all, total genes. hits: genes; universe: (gene, term) pairs;
    genes: those of the universe, if they are at hand in a table that is read faster."""
    genes = (universe if genes is None else genes).select(gene).distinct()
    n_all = genes.agg(F.count(F.lit(1)).alias("total"))
    found = genes.join(hits.select(gene).distinct(), gene, "left_semi")
    n_hit = found.agg(F.count(F.lit(1)).alias("drawn"))
    pairs = universe.select(gene, term).distinct().join(found.withColumn("_hit", F.lit(1)), gene, "left")
    counts = pairs.groupBy(F.col(term).alias("term")).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("size"))
    fold = (F.col("hits") / F.col("drawn")) / (F.col("size") / F.col("total"))
    return counts.where(F.col("size") >= min_size).crossJoin(n_hit).crossJoin(n_all).withColumn("fold", fold)  # one row each


def enrich(hits: DataFrame, universe: DataFrame, gene: str, term: str, min_size: int = 1, method: str = "bh", genes: DataFrame | None = None) -> DataFrame:
    """The counts, the hypergeometric p of at least that many hits, and its adjusted value."""
    from tessella.operators.pvalues import adjust

    ship(universe.sparkSession)
    # the adjustment reads its rows several times
    out = overlap_counts(hits, universe, gene, term, min_size, genes)
    out = materialized(out.withColumn("p", hypergeometric_sf(F.col("hits"), F.col("total"), F.col("size"), F.col("drawn"))))
    return adjust(out, "p", "term", method)

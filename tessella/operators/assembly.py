"""Assemblies: lengths and gaps of contigs, and profiles of their k-mers. Sequences are strings, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sequence import kmer_count


def length_metrics(rows: DataFrame, length: str, shares: tuple[float, ...] = (0.5, 0.9), genome_size: int = 0) -> DataFrame:
    """For each share x: Nx (the length at which contigs, longest first, reach x of all bases, or of `genome_size`) and Lx
    (how many that takes); with the contigs, bases, longest and auN. Lengths are counted first: one row for each."""
    t = rows.where(F.col(length) > 0).groupBy(F.col(length).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    whole = t.agg(F.sum("c").alias("contigs"), F.sum(F.col("c") * F.col("len")).alias("bases"), F.max("len").alias("longest"), (F.sum(F.col("c") * F.col("len") * F.col("len")) / F.sum(F.col("c") * F.col("len"))).alias("aun"))
    w = Window.orderBy(F.desc("len"))  # distinct lengths
    t = t.withColumn("to", F.sum(F.col("c") * F.col("len")).over(w)).withColumn("before", F.sum("c").over(w) - F.col("c"))
    goal = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    t = t.crossJoin(whole.select("*", goal))  # one row for each share
    want = F.col("share") * (F.lit(genome_size) if genome_size else F.col("bases"))
    reached = t.where(F.col("to") >= want)
    need = F.ceil((want - (F.col("to") - F.col("c") * F.col("len"))) / F.col("len"))
    first = reached.groupBy("share").agg(F.max(F.struct("len", (F.col("before") + need).alias("l"))).alias("x"))
    return whole.select("*", goal).join(first, "share", "left").select("share", F.col("x.len").alias("nx"), F.col("x.l").cast("long").alias("lx"), "contigs", "bases", "longest", "aun")


def gap_stats(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Runs of N, bases in them, and the longest."""
    runs = F.regexp_extract_all(F.upper(F.col(seq)), F.lit("N+"), F.lit(0))
    t = rows.select(F.col(key).alias("key"), F.length(seq).alias("length"), F.transform(runs, F.length).alias("g"))
    return t.select("key", "length", F.size("g").alias("gaps"), F.aggregate("g", F.lit(0), lambda a, x: a + x).alias("gap_bases"), F.coalesce(F.array_max("g"), F.lit(0)).alias("longest_gap"))


def length_bins(rows: DataFrame, length: str, edges: list[int]) -> DataFrame:
    """Contigs and bases by length, from an edge to below the next; the last bin has no end."""
    t = rows.where(F.col(length) >= edges[0])
    return t.groupBy(_last(edges, length).alias("low")).agg(F.count(F.lit(1)).alias("contigs"), F.sum(length).cast("long").alias("bases"))


def _last(edges: list[int], length: str):
    of = F.lit(edges[0]).cast("long")
    for e in edges[1:]:
        of = F.when(F.col(length) >= e, F.lit(e).cast("long")).otherwise(of)
    return of


def kmer_profile(rows: DataFrame, key: str, seq: str, k: int = 3) -> DataFrame:
    """k-mers over A, C, G, T: how many, the distinct share, entropy in bits, and the commonest (the least of ties) with its share."""
    t = kmer_count(rows, key, seq, k)
    whole = t.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("n") * F.log2("n")).alias("h"), F.min(F.struct((-F.col("n")).alias("n"), "kmer")).alias("top"))
    total = F.col("total")
    return whole.select("key", "total", (F.col("distinct") / total).alias("distinct_share"), (F.log2(total) - F.col("h") / total).alias("entropy"), F.col("top.kmer").alias("dominant"), (-F.col("top.n") / total).alias("dominant_share"))

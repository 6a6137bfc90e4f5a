"""Sequences as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC nucleotide codes and the bases they stand for. Fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def windows(s: Column, size: int, step: int = 1) -> Column:
    """All windows of `size` characters at every `step`-th place, from one walk over the text (a substring by place would walk it anew each time)."""
    go = f".{{{step}}}" if 1 < step <= size else ""
    pattern = f"(.{{{size}}}).{{0,{step - size}}}" if step > size else f"(?=(.{{{size}}})){go}"
    return F.regexp_extract_all(s, F.lit(f"(?s){pattern}"), F.lit(1))


def kmer_count(rows: DataFrame, key: str, seq: str, k: int = 3, alphabet: str | None = "ACGT") -> DataFrame:
    """Counts of all overlapping k-mers of each sequence (upper case), those over `alphabet` if given."""
    out = rows.select(F.col(key).alias("key"), F.explode(windows(F.upper(F.col(seq)), k)).alias("kmer"))
    if alphabet:
        out = out.where(F.col("kmer").rlike(f"^[{alphabet}]+$"))
    return out.groupBy("key", "kmer").agg(F.count(F.lit(1)).alias("n"))


def motif_scan(rows: DataFrame, key: str, seq: str, motifs: dict[str, str]) -> DataFrame:
    """Overlapping occurrences of IUPAC motifs."""
    s = F.upper(F.col(seq))
    pattern = lambda m: "".join(f"[{IUPAC[c]}]" for c in m.upper())
    return rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(n).alias("motif"), F.regexp_count(s, F.lit(f"(?={pattern(m)})")).alias("n")) for n, m in motifs.items()])).alias("x")).select("key", "x.*")


def sequence_stats(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Length, GC share of A, C, G, T, and share of N."""
    s = F.upper(F.col(seq))
    n = lambda p: F.regexp_count(s, F.lit(p))
    return rows.select(F.col(key).alias("key"), F.length(s).alias("length"), n("[GC]").alias("gc"), n("[ACGT]").alias("acgt"), n("N").alias("n")).select("key", "length", F.when(F.col("acgt") > 0, F.col("gc") / F.col("acgt")).alias("gc"), F.when(F.col("length") > 0, F.col("n") / F.col("length")).alias("n_share"))


def composition(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Share of each letter."""
    s = rows.select(F.col(key).alias("key"), F.explode(F.split(F.upper(F.col(seq)), "")).alias("letter")).where("letter <> ''")
    c = s.groupBy("key", "letter").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("key")))


def reverse_complement(rows: DataFrame, seq: str, name: str = "reverse_complement") -> DataFrame:
    return rows.withColumn(name, F.reverse(F.translate(F.col(seq), "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd")))


def deduplicate(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row (least key) of each sequence, and how many share it."""
    return rows.groupBy(seq).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def linguistic_complexity(rows: DataFrame, key: str, seq: str, k: int = 3) -> DataFrame:
    """Distinct k-mers over those possible, min(4^k, length - k + 1), and the Shannon entropy of letters in bits."""
    t = kmer_count(rows, key, seq, k, None).groupBy("key").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
    return t.select("key", "distinct", "total", (F.col("distinct") / F.least(F.lit(4**k), F.col("total"))).alias("complexity"))

"""Quality of alignments, from rows with a bitwise flag as in SAM: sums of conditions, one row or one for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the flag. Fixed values.
BITS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024, "supplementary": 2048}


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(BITS[name])) != 0


def flagstat(rows: DataFrame, flag: str = "flag") -> DataFrame:
    """Counts by flag over all rows, in one pass: primary, secondary, supplementary, duplicates, mapped, paired, read 1 and
    2, properly paired, both mapped, singletons, failed. Pair counts are of primary rows."""
    f = F.col(flag)
    bit = {n: has(f, n) for n in BITS}
    primary = ~bit["secondary"] & ~bit["supplementary"]
    pair = primary & bit["paired"]
    here = ~bit["unmapped"]
    counted = {
        "primary": primary, "secondary": bit["secondary"], "supplementary": bit["supplementary"] & ~bit["secondary"], "duplicates": bit["duplicate"], "failed": bit["failed"], "mapped": here, "primary_mapped": primary & here,
        "paired": pair, "read1": pair & bit["first"], "read2": pair & bit["second"], "proper": pair & bit["proper"] & here, "both_mapped": pair & here & ~bit["mate_unmapped"], "singletons": pair & here & bit["mate_unmapped"],
    }
    return rows.where(f.isNotNull()).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counted.items()])


def mapq_distribution(rows: DataFrame, flag: str = "flag", mapq: str = "mapq", most: int = 60) -> DataFrame:
    """Primary mapped rows by mapping quality, those above `most` counted there, with the share at or above each quality."""
    f = F.col(flag)
    used = rows.where(~has(f, "secondary") & ~has(f, "supplementary") & ~has(f, "unmapped") & F.col(mapq).isNotNull())
    t = used.groupBy(F.least(F.col(mapq).cast("int"), F.lit(most)).alias("mapq")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.orderBy(F.desc("mapq"))  # qualities, 256 at most
    return t.withColumn("at_least", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))


def read_lengths(rows: DataFrame, length: str) -> DataFrame:
    """Rows, bases, least, mean, median and largest length, and N50 of the reads; lengths are counted first."""
    from tessella.operators.assembly import length_metrics

    t = rows.where(F.col(length) > 0).groupBy(F.col(length).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    one = t.agg(F.min("len").alias("least"), (F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean"), F.percentile("len", 0.5, F.col("c")).alias("median"))
    return length_metrics(rows, length, (0.5,)).select(F.col("contigs").alias("reads"), "bases", "longest", F.col("nx").alias("n50")).crossJoin(one)  # one row each

"""Multiple-testing correction. Ranks and running minima go through ranges and blocks, so no task holds all p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import clean, global_row_number


def _extreme(df: DataFrame, rank: str, value: str, name: str, descending: bool, size: int = 1 << 16) -> DataFrame:
    """Running minimum from the largest rank down (BH), or maximum from the smallest up (Holm), by blocks of ranks."""
    how = F.min if descending else F.max
    block = F.floor((F.col(rank) - 1) / size)
    keyed = df.withColumn("_block", block)
    sums = keyed.groupBy("_block").agg(how(value).alias("_x"))
    other = F.col("b._block") > F.col("a._block") if descending else F.col("b._block") < F.col("a._block")
    beyond = sums.alias("a").join(sums.alias("b"), other, "left").groupBy("a._block").agg(how("b._x").alias("_beyond")).select("_block", "_beyond")
    order = F.col(rank).desc() if descending else F.col(rank).asc()
    inner = how(value).over(Window.partitionBy("_block").orderBy(order))
    pick = F.least if descending else F.greatest
    return keyed.withColumn(name, inner).join(beyond, "_block").withColumn(name, pick(F.col(name), F.coalesce("_beyond", name))).drop("_block", "_beyond")


def adjust(rows: DataFrame, p: str, key: str, method: str = "bh") -> DataFrame:
    """Adds q: bh, by, holm or bonferroni. Missing p keep a missing q and are not counted."""
    v = clean(p)
    n = rows.where(v.isNotNull()).count()
    if method == "bonferroni":
        return rows.withColumn("q", F.least(v * n, F.lit(1.0)))
    ranked = global_row_number(rows.where(v.isNotNull()), p, key, name="_k")
    if method == "holm":
        out = _extreme(ranked.withColumn("_raw", v * (n - F.col("_k") + 1)), "_k", "_raw", "q", False)
    else:
        # the harmonic number of n, summed for small n and by its expansion beyond
        harmonic = 1.0 if method == "bh" else (sum(1 / i for i in range(1, n + 1)) if n < 10**6 else __import__("math").log(n) + 0.5772156649015329 + 1 / (2 * n))
        out = _extreme(ranked.withColumn("_raw", v * n * harmonic / F.col("_k")), "_k", "_raw", "q", True)
    out = out.withColumn("q", F.least("q", F.lit(1.0))).drop("_k", "_raw")
    return out.unionByName(rows.where(v.isNull()).withColumn("q", F.lit(None).cast("double")))


def storey(rows: DataFrame, p: str, key: str, lam: float = 0.5) -> DataFrame:
    """q-values with the share of true nulls estimated from the p above `lam`."""
    v = clean(p)
    n, above = rows.agg(F.count(v), F.count_if(v > lam)).first()
    pi0 = min(1.0, above / ((1 - lam) * n)) if n else 1.0
    return adjust(rows, p, key, "bh").withColumn("q", F.least(F.col("q") * pi0, F.lit(1.0)))


def correction(rows: DataFrame, p: str, key: str, method: str = "bonferroni", alpha: float = 0.05) -> DataFrame:
    out = adjust(rows, p, key, "bh" if method == "fdr" else "bonferroni").withColumnRenamed("q", "Q_VALUE")
    return out.withColumn("SIGNIFICANT", F.coalesce(F.col("Q_VALUE") <= alpha, F.lit(False)))

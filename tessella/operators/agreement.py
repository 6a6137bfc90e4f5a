"""Agreement and association of two measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean


def bland_altman(rows: DataFrame, a: str, b: str, z: float = 1.959963984540054) -> DataFrame:
    d = clean(a) - clean(b)
    return rows.agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd")).select("n", "bias", "sd", (F.col("bias") - z * F.col("sd")).alias("low"), (F.col("bias") + z * F.col("sd")).alias("high"))


def concordance(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Lin's coefficient with population moments, Pearson's r and the bias correction."""
    x, y = clean(a), clean(b)
    both = rows.where(x.isNotNull() & y.isNotNull())
    m = both.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"), F.corr(x, y).alias("pearson"))
    ccc = 2 * F.col("c") / (F.col("vx") + F.col("vy") + (F.col("mx") - F.col("my")) ** 2)
    return m.select(ccc.alias("ccc"), "pearson", (ccc / F.col("pearson")).alias("bias_correction"))


def cronbach_alpha(cells: DataFrame, sample: str, item: str, value: str) -> DataFrame:
    """From complete long cells: alpha of the items, sample variances."""
    v = clean(value)
    items = cells.groupBy(item).agg(F.var_samp(v).alias("v")).agg(F.sum("v").alias("vi"), F.count(F.lit(1)).alias("k"))
    whole = cells.groupBy(sample).agg(F.sum(v).alias("t")).agg(F.var_samp("t").alias("vt"))
    return items.crossJoin(whole).select((F.col("k") / (F.col("k") - 1) * (1 - F.col("vi") / F.col("vt"))).alias("alpha"), "k")


def linear_fit(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares of y on x for each group: slope, intercept, r squared, standard error of the slope."""
    a, b = clean(x), clean(y)
    both = rows.where(a.isNotNull() & b.isNotNull())
    m = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("c"))
    slope = F.col("c") / F.col("vx")
    rest = F.col("n") * (F.col("vy") - F.col("c") ** 2 / F.col("vx"))
    return m.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), (F.col("c") ** 2 / (F.col("vx") * F.col("vy"))).alias("r_squared"), F.sqrt(rest / (F.col("n") - 2) / (F.col("n") * F.col("vx"))).alias("se"), "n")

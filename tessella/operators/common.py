"""Helpers that several operators share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(value: str | Column) -> Column:
    """NaN and infinities count as missing, like null."""
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def over(*keys: str):
    return Window.partitionBy(*keys)


def null_safe_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on `on` in which nulls are equal; the columns of `b` besides `on` are added."""
    keys = {c: f"_on{i}" for i, c in enumerate(on)}
    other = b.withColumnsRenamed(keys)
    match = reduce(and_, [a[c].eqNullSafe(other[k]) for c, k in keys.items()])
    return a.join(other, match, how).drop(*keys.values())


def materialized(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iterative operator: writes `df` as Parquet below spark.checkpoint.dir, which all machines
    share, and reads it back. Where that is unset, as in tests, a folder of the warehouse stands in."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{(root or spark.conf.get('spark.sql.warehouse.dir') + '/_scratch').rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str], parts: int = 64, sample: int = 1 << 13, each: int = 1 << 22, tree: int = 1 << 10) -> DataFrame:
    """Adds `_range` to `df`, by cuts drawn from it."""
    return ranges(df, order, parts, sample, each, tree)(df)


def ranges(df: DataFrame, order: list[str], parts: int = 64, sample: int = 1 << 13, each: int = 1 << 22, tree: int = 1 << 10) -> Callable[[DataFrame], DataFrame]:
    """Draws cuts from `df`; what it returns adds `_range` to any table with the columns of `order`: equal rows share it and
    it grows with `order` (ascending, missing last), so that a window within a range and the totals of the ranges before it
    replace one window over all rows.

    There is a range for every `each` rows, `parts` at least, by the number of rows as the random draw tells it: of n
    uniform numbers the k-th smallest is about k / n. The cuts come from `sample` random rows, or from a second draw of 16
    for each range if that is more; they decide the balance and never the result. Up to `tree` cuts are constants of the
    plan, searched by halving; beyond, the tree finds a run of cuts, one of which falls on `each` rows, and the rows look
    into theirs."""
    key = [part for c in order for part in (F.col(c).isNull(), F.col(c))]
    ascending = [F.col(c).asc_nulls_last() for c in order]
    drawn = df.select(*order, F.rand(7).alias("_u")).orderBy("_u").limit(sample).orderBy(*ascending).collect()
    rows = sample / max(r["_u"] for r in drawn) if len(drawn) == sample else len(drawn)
    parts = max(parts, math.ceil(rows / each))
    if 16 * parts > len(drawn) == sample:
        drawn = df.select(*order).where(F.rand(11) < 16 * parts / rows).orderBy(*ascending).collect()
    drawn = [tuple(r[: len(order)]) for r in drawn]
    cuts = list(dict.fromkeys(drawn[len(drawn) * k // parts] for k in range(1, parts))) if drawn else []
    types = {f.name: f.dataType for f in df.select(*order).schema.fields}
    fold = max(1, math.ceil(len(cuts) / tree))
    edges = [F.struct(*[x for c, v in zip(order, cut, strict=True) for x in (F.lit(v is None), F.lit(v).cast(types[c]))]) for cut in cuts[fold - 1 :: fold]]

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.struct(*key) < edges[mid], place(low, mid)).otherwise(place(mid + 1, high))

    if fold == 1:
        return lambda rows: rows.withColumn("_range", place(0, len(edges)))
    fields = [x for i, c in enumerate(order) for x in (T.StructField(f"m{i}", T.BooleanType()), T.StructField(f"v{i}", types[c]))]
    schema = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.StructType(fields)))])
    runs = [(g, [tuple(x for v in cut for x in (v is None, v)) for cut in cuts[g * fold : (g + 1) * fold - 1]]) for g in range(len(edges) + 1)]
    fine = df.sparkSession.createDataFrame(runs, schema)
    within = F.size(F.filter("_cuts", lambda cut: cut <= F.struct(*key)))
    return lambda rows: rows.withColumn("_range", place(0, len(edges))).join(F.broadcast(fine), "_range").withColumn("_range", F.col("_range") * fold + within).drop("_cuts").select(*rows.columns, "_range")


def with_before(keyed: DataFrame, within: list[str], **totals: tuple[str, Column]) -> DataFrame:
    """Adds for each name the sum, min or max of an expression over the ranges before a row's own (missing in the first)."""
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    w = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    each = keyed.groupBy(*within, "_range").agg(*[of[how](e).alias(f"_t_{name}") for name, (how, e) in totals.items()])
    before = each.select(*within, "_range", *[of[how](f"_t_{name}").over(w).alias(name) for name, (how, _) in totals.items()])
    return null_safe_join(keyed, before, [*within, "_range"])


def running(df: DataFrame, order: list[str], within: list[str], **totals: tuple[str, Column]) -> DataFrame:
    """Adds for each name the sum, min or max of an expression over the rows of its group up to and with each row (rows of
    equal `order` follow one another in any order)."""
    whole = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    of = {"sum": F.sum, "min": F.min, "max": F.max}
    w = Window.partitionBy(*within, "_range").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    keyed = with_before(ranged(df, order), within, **{f"_b_{name}": t for name, t in totals.items()})
    for name, (how, e) in totals.items():
        keyed = keyed.withColumn(name, whole[how](of[how](e).over(w), F.col(f"_b_{name}")))
    return keyed.drop("_range", *[f"_b_{name}" for name in totals])


def global_row_number(df: DataFrame, value: str, *ties: str, name: str = "rn", parts: int = 64, within: list[str] | None = None) -> DataFrame:
    """Adds the 1-based rank of each row in ascending (value, ties), missing last, by group of `within` if given; no task
    holds all rows or a whole group."""
    group = within or []
    keyed = with_before(ranged(df, [value, *ties], parts), group, _before=("sum", F.lit(1)))
    w = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_last() for c in (value, *ties)])
    return keyed.withColumn(name, (F.row_number().over(w) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_before")


def counted(df: DataFrame, keys: list[str], value: str | Column, weight: str | Column | None = None) -> DataFrame:
    """The distinct values of each group with their ranks: keys, _v, _c (rows, or the sum of `weight`), _k (dense rank) and
    _upto (rows up to and with the value). Values are counted first, so one that many rows share is one row."""
    v = clean(value)
    tally = df.select(*keys, v.alias("_v"), (F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight).alias("_w")).where("_v is not null").groupBy(*keys, "_v").agg(F.sum("_w").cast("long").alias("_c"))
    keyed = with_before(ranged(tally, ["_v"]), keys, _b=("sum", F.col("_c")), _d=("sum", F.lit(1)))
    w = Window.partitionBy(*keys, "_range").orderBy("_v")
    upto, dense = F.sum("_c").over(w) + F.coalesce("_b", F.lit(0)), F.row_number().over(w) + F.coalesce("_d", F.lit(0))
    return keyed.select(*keys, "_v", "_c", dense.cast("long").alias("_k"), upto.alias("_upto"))


def quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: list[float], name: str = "q", weight: str | Column | None = None) -> DataFrame:
    """keys and an array of exact quantiles by linear interpolation, from counted distinct values: groups of any size.
    A group without values has no row (without keys: one row of nulls)."""
    spans = counted(df, keys, value, weight)
    size = spans.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    rows = null_safe_join(spans, size, keys) if keys else spans.crossJoin(F.broadcast(size))  # one row
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v")))
    found = []
    for share in shares:
        place = (F.col("_n") - 1) * F.lit(float(share))
        found += [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]
    out = rows.groupBy(*keys).agg(*[e.alias(f"_q{i}") for i, e in enumerate(found)])
    between = [F.col(f"_q{i}") * (1 - F.col(f"_q{i + 2}")) + F.col(f"_q{i + 1}") * F.col(f"_q{i + 2}") for i in range(0, len(found), 3)]
    return out.select(*keys, F.array(*between).alias(name))


def average_rank(df: DataFrame, value: str, name: str = "rank", within: list[str] | None = None, method: str = "average") -> DataFrame:
    """Adds the rank of each value, within a group if given; missing values get none. Ties get their average, least,
    largest or dense rank."""
    keys = within or []
    rank = {"average": F.col("_upto") - (F.col("_c") - 1) / 2, "min": F.col("_upto") - F.col("_c") + 1, "max": F.col("_upto"), "dense": F.col("_k")}[method]
    spans = counted(df, keys, value).select(*keys, "_v", rank.cast("double").alias(name))
    return null_safe_join(df.withColumn("_v", clean(value)), spans, [*keys, "_v"], "left").drop("_v")


def running_sum(df: DataFrame, rank: str, value: str, name: str, size: int = 1 << 16) -> DataFrame:
    """Adds the sum of `value` up to each row in the order of `rank` (1, 2, ...): sums of blocks, then within a block."""
    keyed = df.withColumn("_range", F.floor((F.col(rank) - 1) / size))
    inner = F.sum(value).over(Window.partitionBy("_range").orderBy(rank))
    return with_before(keyed, [], _before=("sum", F.col(value))).withColumn(name, inner + F.coalesce("_before", F.lit(0))).drop("_range", "_before")

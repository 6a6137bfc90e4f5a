"""Selection, joins, unions and rearrangement of labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import clean


def select_labels(cells: DataFrame, dim: str, labels: list) -> DataFrame:
    """Keeps the listed labels; pos is their place in the list. Doubles in the list are an error."""
    if len(set(labels)) != len(labels):
        raise ValueError("labels must be distinct")
    order = cells.sparkSession.createDataFrame([(v, i) for i, v in enumerate(labels)], f"_label {cells.schema[dim].dataType.simpleString()}, pos int")
    return cells.drop("pos").join(F.broadcast(order), cells[dim] == order["_label"]).drop("_label")


def drop_labels(cells: DataFrame, dim: str, labels: list) -> DataFrame:
    """Removes the listed labels; rows without a label stay."""
    return cells.where(~F.coalesce(F.col(dim).isin(labels), F.lit(False)))


def rename_dim(cells: DataFrame, old: str, new: str) -> DataFrame:
    if old not in cells.columns or new in cells.columns:
        raise ValueError(f"cannot rename {old} to {new}")
    return cells.withColumnRenamed(old, new)


def transpose(cells: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """The axes in another order; a permutation of the columns, no data moves."""
    if sorted(order) != sorted(c for c in cells.columns if c != value):
        raise ValueError("order must name every axis once")
    return cells.select(*order, value)


def concat(tables: list[DataFrame], axis: str, other: str) -> DataFrame:
    """Appends tables along `axis`; of `other` the labels that all have stay. A label of `axis` in two tables is the caller's error (checked by `concat_checked`)."""
    common = tables[0].select(other).distinct()
    for t in tables[1:]:
        common = common.join(t.select(other).distinct(), other, "left_semi")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.join(common, other, "left_semi")


def concat_checked(tables: list[DataFrame], axis: str, other: str) -> DataFrame:
    seen = tables[0].select(axis).distinct()
    for t in tables[1:]:
        if not seen.join(t.select(axis).distinct(), axis, "left_semi").isEmpty():
            raise ValueError(f"a label of {axis} is in two tables")
        seen = seen.union(t.select(axis).distinct())
    return concat(tables, axis, other)


def join_tables(data: DataFrame, meta: DataFrame, dim: str, columns: list[str] | None = None, how: str = "inner", prefix: str = "") -> DataFrame:
    """Adds columns of `meta` by label; inner or left. Column names must not clash after `prefix`."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    columns = columns or [c for c in meta.columns if c != dim]
    clash = {prefix + c for c in columns} & set(data.columns)
    if clash:
        raise ValueError(f"columns in both tables: {sorted(clash)}")
    return data.join(meta.select(dim, *[F.col(c).alias(prefix + c) for c in columns]), dim, how)


def annotate(target: DataFrame, reference: DataFrame, key: str, ref_key: str, fields: list[str]) -> DataFrame:
    """Left join of reference fields as numbers; what is no number or has no match is missing."""
    ref = reference.select(F.col(ref_key).alias("_key"), *[clean(F.expr(f"try_cast(`{f}` as double)")).alias(f) for f in fields])
    return target.join(ref, target[key] == ref["_key"], "left").drop("_key")


def attach_info(target: DataFrame, source: DataFrame, dim: str, fields: list[str]) -> DataFrame:
    """Left join of fields as they are."""
    return target.join(source.select(dim, *fields), dim, "left")


def explode_field(rows: DataFrame, field: str, sep: str = ";", keep_empty: bool = False, pos: str = "pos") -> DataFrame:
    """One row for each trimmed, non-empty part of a field; with keep_empty a row without parts stays as `<pos>#empty`."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(field), F.lit("")), f"\\Q{sep}\\E"), lambda x: F.trim(x)), lambda x: x != "")
    if keep_empty:
        parts = F.when(F.size(parts) == 0, F.array(F.concat(F.col(pos).cast("string"), F.lit("#empty")))).otherwise(parts)
    return rows.select("*", F.posexplode(parts).alias("part_pos", "part"))


def pivot(rows: DataFrame, index: str, columns: str, values: str | None = None, agg: str = "sum", labels: list | None = None) -> DataFrame:
    """Long to wide; absent pairs are 0. Without `values` every row counts 1."""
    how = {"sum": F.sum, "first": F.first, "max": F.max, "min": F.min, "count": F.count}[agg]
    v = F.col(values) if values else F.lit(1)
    return rows.groupBy(index).pivot(columns, labels).agg(how(v)).na.fill(0)


def filter_by(cells: DataFrame, metrics: DataFrame, dim: str, rules: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Keeps labels whose metrics lie within all (field, least, most), ends included; a missing metric never passes."""
    ok = F.lit(True)
    for field, least, most in rules:
        v = clean(field)
        ok = ok & v.isNotNull()
        if least is not None:
            ok = ok & (v >= least)
        if most is not None:
            ok = ok & (v <= most)
    return cells.join(metrics.where(ok).select(dim), dim, "left_semi")


def filter_min(cells: DataFrame, dim: str, value: str = "value", min_value: float = 1, min_samples: int = 1) -> DataFrame:
    """Keeps labels with at least `min_samples` cells of at least `min_value`."""
    good = cells.groupBy(dim).agg(F.count_if(clean(value) >= min_value).alias("_n")).where(F.col("_n") >= min_samples)
    return cells.join(good.select(dim), dim, "left_semi")


def missing_filter(cells: DataFrame, dim: str, value: str = "value", threshold: float = 0.1) -> DataFrame:
    """Keeps labels whose share of missing cells is at most `threshold`."""
    good = cells.groupBy(dim).agg(F.avg(clean(value).isNull().cast("double")).alias("_m")).where(F.col("_m") <= threshold)
    return cells.join(good.select(dim), dim, "left_semi")


def rank_axis(cells: DataFrame, dim: str, by: str, value: str = "value", top_n: int | None = None, min_value: float | None = None, keep_ties: bool = False, descending: bool = True) -> DataFrame:
    """Labels by a statistic of their cells, ranked; missing statistics last, ties in label order. The top ones stay."""
    v = clean(value)
    stat = {"variance": F.var_pop(v), "std": F.stddev_pop(v), "mean": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "nonzero": F.count_if(v != 0).cast("double"), "abs_mean": F.avg(F.abs(v)), "max": F.max(v)}[by]
    out = cells.groupBy(dim).agg(stat.alias("statistic"))
    if min_value is not None:
        out = out.where(F.col("statistic") >= min_value)
    first = F.col("statistic").desc_nulls_last() if descending else F.col("statistic").asc_nulls_last()
    if top_n is not None and not keep_ties:
        out = out.orderBy(first, F.col(dim)).limit(top_n)
    elif top_n is not None:  # the value at the cut, then all that reach it
        cut = out.where("statistic is not null").orderBy(first).limit(top_n).agg(F.min("statistic") if descending else F.max("statistic")).first()[0]
        out = out.where(F.col("statistic") >= cut if descending else F.col("statistic") <= cut) if cut is not None else out.limit(0)
    return out.withColumn("rank", (F.rank() if keep_ties else F.row_number()).over(Window.orderBy(first, *([] if keep_ties else [F.col(dim)])))) if top_n is not None else out


def prioritize(rows: DataFrame, by: str, top_n: int, pos: str, ascending: bool = False) -> DataFrame:
    """The top rows by a field, missing last; descending ties favour the later position."""
    v = clean(by)
    order = [v.asc_nulls_last(), F.col(pos).asc()] if ascending else [v.desc_nulls_last(), F.col(pos).desc()]
    return rows.orderBy(*order).limit(top_n)


def order_axis(rows: DataFrame, by: str, pos: str, descending: bool = False) -> DataFrame:
    """New positions by a field: missing last either way; descending reverses the order of ties. Global, so by ranges."""
    from tessella.operators.common import global_row_number

    v = clean(by)
    keyed = rows.withColumn("_by", -v if descending else v).withColumn("_tie", -F.col(pos) if descending else F.col(pos))
    return global_row_number(keyed, "_by", "_tie", name="new_pos").withColumn("new_pos", F.col("new_pos") - 1).drop("_by", "_tie")

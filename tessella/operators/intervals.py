"""Half-open intervals on named sequences: overlap, nearest, merge, gaps, coverage, similarity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import materialized, null_safe_join, quantiles, ranged, running, with_before


def _binned(rows: DataFrame, start: str, end: str, width: int, name: str = "_bin") -> DataFrame:
    low, high = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width)
    return rows.withColumn(name, F.explode(F.sequence(low, high)))


def _meeting(a: DataFrame, b: DataFrame, on: list[str], min_overlap: int, width: int) -> DataFrame:
    """Pairs of equal `on` with at least `min_overlap` positions in common (`overlap`), taken in the bin where these begin."""
    low, size = F.greatest("a_start", "b_start"), F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return a.join(b, on).where((size >= min_overlap) & (F.floor(low / width) == F.col("_bin"))).withColumn("overlap", size)


def _copies(rows: DataFrame, side: str, chrom: str, start: str, end: str, id_col: str, most: int) -> DataFrame:
    """chrom, the start and end of each distinct interval, and its ids as an array; one of over `most` rows is several arrays."""
    place = ["chrom", f"{side}_start", f"{side}_end"]
    t = materialized(rows.select(F.col(id_col).alias("_id"), F.col(chrom).alias("chrom"), F.col(start).alias(place[1]), F.col(end).alias(place[2])).dropna(subset=place))
    many = t.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    parted = t.join(many, place, "left").withColumn("_part", F.pmod(F.xxhash64("_id"), F.coalesce(F.ceil(F.col("_n") / most), F.lit(1))))
    return parted.groupBy(*place, "_part").agg(F.flatten(F.collect_list(F.array("_id"))).alias(f"{side}_ids"))  # null ids stay


def overlapping(a: DataFrame, b: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", id_col: str = "id", min_overlap: int = 1, width: int = 64, most: int = 1 << 12, side: int = 1 << 13, fine: int = 1 << 20) -> DataFrame:
    """The pairs of `overlap` before they are written out: distinct intervals with the ids of their rows, a_ids and b_ids.

    An equi-join on bins of `width` positions; a pair is taken in the bin where the overlap begins. A bin is cut into cells
    of about `side` by `side` rows, and the cells are dealt to tasks by the pairs of rows that they can give: `fine` a task
    up to 2,048 tasks, beyond that more, up to a whole cell."""
    sides = {}
    for name, rows in (("a", a), ("b", b)):
        t = materialized(_copies(rows, name, chrom, start, end, id_col, most))
        sides[name] = _binned(t, f"{name}_start", f"{name}_end", width)
    rows_of = [t.groupBy("chrom", "_bin").agg(F.sum(F.size(f"{name}_ids")).alias(f"_{name}")) for name, t in sides.items()]
    bins = materialized(rows_of[0].join(rows_of[1], ["chrom", "_bin"]))
    total = bins.agg(F.sum(F.col("_a") * F.col("_b").cast("double"))).first()[0] or 0
    tasks = max(1, min(1 << 11, math.ceil(total / fine)), math.ceil(total / side**2))
    cells = bins.select("chrom", "_bin", *[F.ceil(F.col(f"_{name}") / side).cast("int").alias(f"_{name}") for name in sides])
    key = ["chrom", "_bin", "_cell_a", "_cell_b"]

    def dealt(name: str, other: str) -> DataFrame:
        t = sides[name].join(cells, ["chrom", "_bin"]).withColumn(f"_cell_{name}", F.pmod(F.hash(f"{name}_start", f"{name}_end", "_part"), f"_{name}"))
        return t.withColumn(f"_cell_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1))).drop("_part", "_a", "_b").repartition(tasks, *key)

    pairs = _meeting(dealt("a", "b").hint("merge"), dealt("b", "a"), key, min_overlap, width)
    share = lambda name: (F.col("overlap") / (F.col(f"{name}_end") - F.col(f"{name}_start"))).alias(f"{name}_fraction")
    return pairs.select("a_ids", "b_ids", "chrom", "overlap", share("a"), share("b"))


def by_row(pairs: DataFrame) -> DataFrame:
    """A row for each id of `a` and each of `b` of pairs of distinct intervals: what they have in common is worked out before."""
    common = [c for c in pairs.columns if c not in ("a_ids", "b_ids")]
    t = pairs.select("a_ids", "b_ids", F.inline(F.array(F.struct(*common))))
    return t.withColumn("a_id", F.explode("a_ids")).withColumn("b_id", F.explode("b_ids")).select("a_id", "b_id", *common)


def overlap(a: DataFrame, b: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", id_col: str = "id", min_overlap: int = 1, width: int = 64) -> DataFrame:
    """Pairs with at least `min_overlap` positions in common, and that as a share of either. Distinct intervals are joined on
    bins of `width` positions (choose it near the usual length), and their rows paired last."""
    return by_row(overlapping(a, b, chrom, start, end, id_col, min_overlap, width))


def _runs(rows: DataFrame, chrom: str, start: str, end: str, max_gap: int) -> DataFrame:
    """chrom, start, end, _upto (the furthest end before the row) and _first (whether a run begins), in ranges of start."""
    keyed = ranged(rows.select(F.col(chrom).alias("chrom"), F.col(start).alias("start"), F.col(end).alias("end")), ["start", "end"])
    w = Window.partitionBy("chrom", "_range").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.greatest(F.max("end").over(w), F.col("_before"))
    t = with_before(keyed, ["chrom"], _before=("max", F.col("end"))).withColumn("_upto", upto).drop("_before")
    return t.withColumn("_first", (F.col("_upto").isNull() | (F.col("start") - F.col("_upto") > max_gap)).cast("long"))


def merge(rows: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", max_gap: int = 0) -> DataFrame:
    """Runs of intervals whose gaps are at most `max_gap`: chrom, start, end, n. A chrom is walked in ranges of its starts."""
    # of equal intervals the one that begins the run comes first, whatever order they were read in
    w = Window.partitionBy("chrom", "_range").orderBy("start", "end", F.desc("_first")).rowsBetween(Window.unboundedPreceding, 0)
    runs = with_before(_runs(rows, chrom, start, end, max_gap), ["chrom"], _before=("sum", F.col("_first")))
    runs = runs.withColumn("_island", F.sum("_first").over(w) + F.coalesce("_before", F.lit(0)))
    return runs.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def _seen(rows: DataFrame, how: str, what) -> DataFrame:
    """Adds p: the largest or smallest `what` of a chrom up to each row in the order of (at, kind), in ranges of it."""
    of = {"min": F.min, "max": F.max}[how]
    both = {"min": F.least, "max": F.greatest}[how]
    w = Window.partitionBy("chrom", "_range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    keyed = with_before(ranged(rows, ["at", "kind"]), ["chrom"], _before=(how, what))
    near, far = of(what).over(w), F.col("_before")
    return keyed.withColumn("_near", near).withColumn("p", F.when(F.col("_near").isNull(), far).when(far.isNull(), F.col("_near")).otherwise(both("_near", far))).drop("_near", "_before", "_range")


def _cover(rows: DataFrame) -> DataFrame:
    """A row for each of the fewest whole runs of 2^_level positions, numbered by _node, that make up [start, end)."""
    t = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("end") - F.col("start"))).cast("int"))))
    t = t.withColumns({"_low": F.expr("-shiftright(-start, _level)"), "_high": F.expr("shiftright(end, _level)")}).where("_low < _high")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    return t.withColumn("_node", F.explode(F.array(F.when(odd("_low"), F.col("_low")), F.when(odd("_high"), F.col("_high") - 1)))).where("_node is not null").drop("_low", "_high")


def _least_overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, start, end of the distinct intervals `a` and the least id of those of `b` that overlap them. Either begins in
    the other: what begins in a run of positions, and what covers one, is known by its least id, so no pairs are made."""
    sound = lambda t: t.where(F.col("end") > F.col("start"))
    a, b = sound(a), sound(b)
    longest = a.select("start", "end").union(b.select("start", "end")).agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
    above = lambda t: t.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(int(longest).bit_length())))).withColumn("_node", F.expr("shiftright(start, _level)"))
    place, least = ["chrom", "_level", "_node"], F.min("id").alias("id")
    begun = above(b.groupBy("chrom", "start").agg(least)).groupBy(*place).agg(least)
    inside = _cover(a).join(begun, place).groupBy("chrom", "start", "end").agg(least)
    covering = _cover(b).groupBy(*place).agg(least)
    held = above(a.select("chrom", "start").distinct()).join(covering, place).groupBy("chrom", "start").agg(least)
    return inside.unionByName(a.join(held, ["chrom", "start"]).select("chrom", "start", "end", "id")).groupBy("chrom", "start", "end").agg(least)


def nearest(a: DataFrame, b: DataFrame, max_distance: int | None = None, chrom: str = "chrom", start: str = "start", end: str = "end", id_col: str = "id", width: int = 64) -> DataFrame:
    """For each of `a` the nearest of `b` on its chrom: 0 if they overlap, else the gap; ties by the least id. Exact: the last
    end at or before, and the first start at or after, by a walk over both sides in ranges; overlaps by runs of positions.
    Only distinct intervals are compared, each of `b` by its least id (`width` has no use any more)."""
    at = [F.col(chrom).alias("chrom"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")]
    asked = materialized(a.select(F.col(id_col).alias("a_id"), *at))
    own = materialized(asked.select("chrom", "start", "end").distinct())
    other = materialized(b.select(*at, F.col(id_col).alias("id")).groupBy("chrom", "start", "end").agg(F.min("id").alias("id")))
    key = F.struct("start", "end").alias("id")
    over_ = _least_overlapping(own, other).select("chrom", key, F.lit(0).cast("long").alias("distance"), F.col("id").alias("b_id"))
    none = F.lit(None).cast(dict(other.dtypes)["id"])
    x = own.select(F.lit(1).alias("kind"), "chrom", F.col("start").alias("at"), F.col("end").alias("to"), key, none.alias("of"))
    y = other.select(F.lit(0).alias("kind"), "chrom", F.col("start").alias("at"), F.col("end").alias("to"), key, F.col("id").alias("of"))
    ends = y.withColumn("at", F.col("to"))
    earlier = F.when(F.col("kind") == 0, F.struct(F.col("at"), (-F.col("of")).alias("k")))
    prev = _seen(x.unionByName(ends), "max", earlier).where("kind = 1 and p is not null")
    left = prev.select("chrom", "id", (F.col("at") - F.col("p.at")).alias("distance"), (-F.col("p.k")).alias("b_id"))
    later = F.when(F.col("kind") == 0, F.struct((-F.col("at")).alias("at"), F.col("of").alias("k")))  # `at` is negated: the walk goes back
    nxt = _seen(x.withColumn("at", F.col("to")).unionByName(y).withColumn("at", -F.col("at")), "min", later).where("kind = 1 and p is not null")
    right = nxt.select("chrom", "id", (F.col("p.at") + F.col("at")).alias("distance"), F.col("p.k").alias("b_id"))
    every = over_.unionByName(left).unionByName(right).groupBy("chrom", "id").agg(F.min(F.struct("distance", "b_id")).alias("m"))
    found = null_safe_join(asked, every.select("chrom", "id.start", "id.end", "m"), ["chrom", "start", "end"])
    out = found.groupBy("a_id").agg(F.min("m").alias("m")).select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.distance").alias("distance"))
    return out if max_distance is None else out.where(F.col("distance") <= max_distance)


def interval_stats(rows: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    t = rows.select(F.col(chrom).alias("chrom"), (F.col(end) - F.col(start)).alias("len"))
    plain = t.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.avg("len").alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"))
    return null_safe_join(plain, quantiles(t, ["chrom"], "len", [0.5]), ["chrom"], "left").select("chrom", "n", "total", "mean", F.col("q")[0].alias("median"), "min", "max")


def gaps(rows: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", min_gap: int = 0) -> DataFrame:
    """Stretches between merged runs longer than `min_gap`."""
    runs = _runs(rows, chrom, start, end, max(min_gap, 0)).where("_first = 1 and _upto is not null")
    return runs.select("chrom", F.col("_upto").alias("start"), F.col("start").alias("end"), (F.col("start") - F.col("_upto")).alias("length"))


def jaccard(a: DataFrame, b: DataFrame, width: int = 1024) -> DataFrame:
    """Of the merged sides: positions in both, in either, and their quotient (0 if none)."""
    x, y = merge(a), merge(b)  # no copies: rows are paired at once
    binned = [_binned(t.select("chrom", F.col("start").alias(f"{n}_start"), F.col("end").alias(f"{n}_end")), f"{n}_start", f"{n}_end", width) for n, t in (("a", x), ("b", y))]
    both = _meeting(*binned, ["chrom", "_bin"], 1, width).agg(F.coalesce(F.sum("overlap"), F.lit(0)).alias("intersection"))
    size = lambda t, name: t.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(name))
    out = both.crossJoin(size(x, "a_bases")).crossJoin(size(y, "b_bases"))  # one row each
    union = F.col("a_bases") + F.col("b_bases") - F.col("intersection")
    return out.select("intersection", union.alias("union"), F.when(union > 0, F.col("intersection") / union).otherwise(0.0).alias("jaccard"))


def coverage(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """For each of `a`: overlapping intervals of `b`, positions covered by any of them, and their share.

    No pairs are made (`width` has no use any more): those that overlap [s, e) begin before e, less those that end by s; the
    covered positions before x are the sum of x - start over the merged runs that begin before it, less that of x - end over
    those that end before it. Both are running sums over the distinct positions of either side."""
    real = lambda t: t.where(F.col("end") > F.col("start")).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def events(t: DataFrame, at: str, kind: int, *values) -> DataFrame:
        return t.select("chrom", F.col(at).alias("at"), F.lit(kind).alias("kind"), *[v.alias(n) for n, v in zip(("began", "ended", "runs", "places"), values, strict=True)])

    own, other = real(a), real(b)
    runs = merge(other)
    rows = [events(other, "start", 2, one, none, none, none), events(other, "end", 0, none, one, none, none), events(runs, "start", 2, none, none, one, F.col("start")), events(runs, "end", 0, none, none, -one, -F.col("end"))]
    rows += [events(own, at, 1, none, none, none, none) for at in ("start", "end")]  # behind what ends there, before what begins
    names = ["began", "ended", "runs", "places"]
    tally = materialized(reduce(DataFrame.unionByName, rows).groupBy("chrom", "at", "kind").agg(*[F.sum(n).alias(n) for n in names]))
    upto = running(tally, ["at", "kind"], ["chrom"], **{f"_{n}": ("sum", F.col(n)) for n in names}).where("kind = 1")
    upto = materialized(upto.select("chrom", "at", "_began", "_ended", (F.col("at") * F.col("_runs") - F.col("_places")).alias("_before")))
    first = upto.select("chrom", F.col("at").alias("start"), F.col("_ended").alias("_out"), F.col("_before").alias("_low"))
    last = upto.select("chrom", F.col("at").alias("end"), F.col("_began").alias("_in"), F.col("_before").alias("_high"))
    size, sound = F.col("end") - F.col("start"), F.col("end") > F.col("start")
    out = a.select("id", "chrom", "start", "end").join(first, ["chrom", "start"], "left").join(last, ["chrom", "end"], "left")
    hits, covered = (F.coalesce(F.when(sound, F.col(x) - F.col(y)), F.lit(0)) for x, y in (("_in", "_out"), ("_high", "_low")))
    return out.select(F.col("id").alias("a_id"), hits.alias("hits"), covered.alias("covered"), F.when(size != 0, covered / size).alias("fraction"))

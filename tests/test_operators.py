import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregate, contingency, intervals, pvalues, repeated, scale, shape
from tessella.operators.common import average_rank, global_row_number, running_sum


def test_intervals_half_open(spark):
    schema = "id long, chrom string, start long, end long"
    a = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 20, 30), (3, "d", 0, 5)], schema)
    b = spark.createDataFrame([(7, "c", 10, 20), (8, "c", 25, 300), (9, "e", 0, 5)], schema)
    assert [(r.a_id, r.b_id, r.overlap) for r in intervals.overlap(a, b, width=8).collect()] == [(2, 8, 5)]
    assert sorted((r.a_id, r.b_id, r.distance) for r in intervals.nearest(a, b, width=8).collect()) == [(1, 7, 0), (2, 7, 0)]  # a touching one is at 0, too; the least id wins
    assert intervals.overlap(a, b.limit(0)).count() == 0
    assert sorted((r.chrom, r.start, r.end, r.n) for r in intervals.merge(a.union(b)).collect()) == [("c", 0, 300, 4), ("d", 0, 5, 1), ("e", 0, 5, 1)]
    assert intervals.jaccard(a.limit(0), b.limit(0)).first().jaccard == 0


def test_aggregate_of_missing_group(spark):
    cells = spark.createDataFrame([("x", "f", None), ("y", "f", float("nan"))], "part string, flag string, value double")
    groups = spark.createDataFrame([("x", "g"), ("y", "g")], "part string, brand string")
    assert aggregate.aggregate(cells, groups, "part", "brand", "flag").first().value == 0
    assert aggregate.aggregate(cells, groups, "part", "brand", "flag", method="mean").first().value is None


def test_bins_and_ties(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,), (None,)], "v double")
    assert sorted(r.bin for r in aggregate.bin_values(rows, "v", 4).collect()) == [-1, 0, 0, 0, 3]
    top = shape.rank_axis(spark.createDataFrame([(k, v) for k, v in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None))], "k string, value double"), "k", "max", top_n=1, keep_ties=True)
    assert sorted((r.k, r["rank"]) for r in top.collect()) == [("b", 1), ("c", 1)]
    down = shape.prioritize(spark.createDataFrame([(0, 3.0), (1, 3.0), (2, None)], "pos int, v double"), "v", 2, "pos")
    assert [r.pos for r in down.collect()] == [1, 0]


def test_shape_errors(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    for bad in (lambda: shape.select_labels(t, "k", ["a", "a"]), lambda: shape.rename_dim(t, "k", "v"), lambda: shape.join_tables(t, t, "k", ["v"]), lambda: shape.concat_checked([t, t], "k", "v"), lambda: shape.transpose(t, ["q"], "v")):
        with pytest.raises(ValueError):
            bad()
    kept = shape.explode_field(spark.createDataFrame([(0, " a ; ;b"), (1, None), (2, ";")], "pos int, f string"), "f", keep_empty=True).collect()
    assert [(r.pos, r.part) for r in kept] == [(0, "a"), (0, "b"), (1, "1#empty"), (2, "2#empty")]


def test_scaling_without_spread(spark):
    t = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("a", None)], "k string, value double")
    assert sorted(r.value for r in scale.zscore(t, "k").collect()) == [0, 0, 0]
    assert sorted(r.value for r in scale.min_max_scale(t, "k").collect()) == [0, 0, 0]
    assert sorted(str(r.value) for r in scale.scale_features(t, "k").collect()) == ["0.0", "0.0", "None"]


def test_global_order(spark):
    rows = spark.range(0, 5000).select("id", (F.col("id") * 7919 % 101).cast("double").alias("v")).repartition(7)
    got = sorted((r.rn, r.v, r.id) for r in global_row_number(rows, "v", "id").collect())
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    ranks = {r.v: r["rank"] for r in average_rank(rows, "v").select("v", "rank").distinct().collect()}
    assert ranks[0.0] == (1 + 50) / 2 and len(ranks) == 101
    sums = running_sum(global_row_number(rows, "v", "id"), "rn", "id", "s", size=64)
    assert sums.agg(F.max("s")).first()[0] == sum(range(5000))


def test_adjustment_with_missing(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "k int, p double")
    assert {r.k: r.q and round(r.q, 6) for r in pvalues.adjust(p, "p", "k").collect()} == {1: 0.03, 2: 0.04, 3: None, 4: 0.04}
    assert {r.k: r.q and round(r.q, 6) for r in pvalues.adjust(p, "p", "k", "holm").collect()} == {1: 0.03, 2: 0.06, 3: None, 4: 0.06}


def test_contingency_and_trend(spark):
    t = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10 + [(None, "x")], "r string, c string")
    row = contingency.association(t, "r", "c").first()
    assert row.chi2 == pytest.approx(20) and row.cramer_v == pytest.approx(1) and row.n == 20
    up = spark.createDataFrame([("k", i, float(i)) for i in range(10)], "key string, t int, v double")
    assert repeated.mann_kendall(up, "key", "t", "v").first().tau == 1 and repeated.sen_slope(up, "key", "t", "v").first().slope == 1


def test_silhouette_works_a_distance_out_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessella.operators import clusters

    seen, plain = [], clusters._distances
    monkeypatch.setattr(clusters, "_distances", lambda a, b: (seen.append(len(a) * len(b)), plain(a, b))[1])
    one = [(1, "x", [0.0, 0.0]), (2, "y", [3.0, 4.0]), (3, "x", [1.0, 1.0])]
    other = [(4, "y", [6.0, 8.0]), (1, "z", [9.0, 9.0]), (5, "z", [5.0, float("nan")])]
    a, b = ([[r[0] for r in t], [r[1] for r in t], np.array([2] * len(t)), pa.array([r[2] for r in t])] for t in (one, other))
    got = {(x is a, x[0][at[p]], x[1][at[p]], names[q]): (s, n) for x, at, names, i, j, sums, ns in clusters._label_sums(a, b) for p, q, s, n in zip(i, j, sums, ns, strict=True)}
    want = {}
    for first, mine, theirs in ((True, one, other), (False, other, one)):
        for k, label, v in mine:
            for o, l, w in theirs:
                if k != o:
                    s, n = want.get((first, k, label, l), (0, 0))
                    d = math.dist(v, w)
                    want[first, k, label, l] = (s, n) if math.isnan(d) else (s + d, n + 1)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sum(seen) == len(one) * len(other)


def test_silhouette_and_dunn_by_blocks(spark):
    import math
    import random

    from tessella.operators import clusters

    rng = random.Random(4)
    rows = [(i, [100 + rng.random(), rng.random(), float(i % 3)], "abc"[i % 3]) for i in range(60)] + [(60, [5.0, 5.0, 5.0], "d"), (61, [100.0, 0.5, 0.0], "a"), (62, [100.0, 0.5, 1e-9], "b"), (None, [0.0] * 3, "a"), (63, None, "a"), (0, [101.0, 1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "k long, v array<double>, l string")
    full = [r for r in rows if r[0] is not None and r[1]]
    pairs = [(p[0], p[2], q[2], math.dist(p[1], q[1])) for p in full for q in full if p[0] != q[0]]
    for block in (7, 4096):
        got = {r["key"]: r for r in clusters.silhouette(df, "k", "v", "l", block=block).collect()}
        assert len(got) == 63
        for k, r in got.items():
            mean = lambda o: (lambda x: sum(x) / len(x) if x else None)([d for p, _, q, d in pairs if p == k and q == o])
            own, near = mean(r["label"]), min(mean(o) for o in "abcd" if o != r["label"])
            assert r["b"] == pytest.approx(near) and (r["a"] is None and r["silhouette"] == 0 if own is None else r["silhouette"] == pytest.approx((near - own) / max(near, own)))
        want = min(d for _, p, q, d in pairs if p != q) / max(d for _, p, q, d in pairs if p == q)
        assert clusters.dunn(df, "k", "v", "l", block=block).first()["dunn"] == pytest.approx(want, rel=1e-9)
    assert clusters.silhouette(df.limit(0), "k", "v", "l").count() == 0 and clusters.dunn(df.limit(0), "k", "v", "l").first()["dunn"] is None


def test_dunn_of_more_than_20000_vectors(spark):
    from tessella.operators import clusters

    df = spark.range(20002).select("id", F.array(F.when(F.col("id") % 2 == 0, 0.0).otherwise(10.0) + F.col("id") / 20001).alias("v"), (F.col("id") % 2).alias("l"))
    assert clusters.dunn(df, "id", "v", "l").first()["dunn"] == pytest.approx((10 + 1 / 20001 - 20000 / 20001) / (20000 / 20001), rel=1e-9)


def test_ewma_of_long_series_with_small_lambda(spark):
    values = [0.0] * 100 + [float(i % 7) for i in range(500)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    for lam in (0.01, 1.0):
        z = sum(values) / len(values)
        for r, v in zip(repeated.ewma_chart(df, "k", ["i"], "v", lam=lam).orderBy("t").collect(), values, strict=True):
            z = lam * v + (1 - lam) * z
            assert r["ewma"] == pytest.approx(z, abs=1e-9)


def test_ranks_and_quantiles_by_ranges(spark):
    """Against sorted lists: ties that half of the rows share, a missing group key, missing values, an empty table."""
    import random

    from tessella.operators.common import average_rank, global_row_number, quantiles, running

    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.5, 1.5, 1.5, None, rng.random(), -rng.random()]), i) for i in range(1500)]
    df = spark.createDataFrame(data + [("c", 4.0, 1500), ("d", None, 1501)], "g string, v double, i int")
    rows = [tuple(r) for r in df.collect()]
    numbered = {r.i: r.rn for r in global_row_number(df, "v", "i", parts=16, within=["g"]).collect()}
    ranks = {r.i: r["rank"] for r in average_rank(df, "v", within=["g"]).collect()}
    sums = {r.i: r.s for r in running(df, ["v", "i"], ["g"], s=("sum", F.col("i"))).collect()}
    quarts = {r.g: r.q for r in quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0.0, r[2]))
        assert [numbered[r[2]] for r in mine] == list(range(1, len(mine) + 1))
        assert [sums[r[2]] for r in mine] == [sum(x[2] for x in mine[: k + 1]) for k in range(len(mine))]
        v = [r[1] for r in mine if r[1] is not None]
        for r in mine:
            assert ranks[r[2]] == (None if r[1] is None else sum(x < r[1] for x in v) + (v.count(r[1]) + 1) / 2)
        if v:
            want = [v[int(h)] + (h - int(h)) * (v[min(int(h) + 1, len(v) - 1)] - v[int(h)]) for h in ((len(v) - 1) * q for q in (0.0, 0.25, 0.5, 1.0))]
            assert all(abs(a - b) < 1e-12 for a, b in zip(quarts[g], want, strict=True))
    assert "d" not in quarts
    assert global_row_number(df.where("false"), "v", within=["g"]).count() == 0
    assert quantiles(df.where("false"), [], "v", [0.5]).first()["q"] == [None]


def test_merge_walks_one_sequence_in_ranges(spark):
    import random

    rng = random.Random(8)
    data = [("x", s, s + rng.choice([1, 3, 400])) for s in (rng.randrange(40000) for _ in range(800))]
    runs = []
    for _, s, e in sorted(data):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    df = spark.createDataFrame(data, "chrom string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.merge(df).collect()) == [tuple(r) for r in runs]
    twice = intervals.merge(df.union(df).repartition(7)).collect()  # equal intervals where a run begins
    assert sorted((r.start, r.end) for r in twice) == [tuple(r) for r in runs] and sum(r.n for r in twice) == 1600
    assert sorted((r.start, r.end) for r in intervals.gaps(df).collect()) == [(a[1], b[0]) for a, b in zip(runs, runs[1:])]


def test_ranges_grow_with_the_rows(spark):
    from tessella.operators.common import ranged

    draw = random.Random(5)
    rows = [(draw.choice([None, float("nan"), draw.random(), 0.5]), draw.choice([None, "a", "b", "c"]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "v double, s string, i long").repartition(4)
    order = lambda r: ((r.v is None, 0.0 if r.v is None else float("inf") if math.isnan(r.v) else r.v), (r.s is None, r.s or ""), r.i)
    for each, tree, least in ((1 << 22, 1 << 10, 8), (20, 1 << 10, 250), (20, 16, 250), (20, 2, 250)):
        got = sorted(ranged(df, ["v", "s", "i"], 8, 256, each, tree).collect(), key=order)
        of = [r._range for r in got]
        assert len(got) == 6000 and of == sorted(of) and len(set(of)) >= least * 0.8
        assert max(of.count(x) for x in set(of)) < 6000 / least * 4
    tied = ranged(df, ["s"], 8, 256, 20, 2).groupBy("s").agg(F.count_distinct("_range").alias("n")).collect()
    assert {r.n for r in tied} == {1}
    assert ranged(df.limit(0), ["v"], 8, 256, 20, 2).count() == 0


def test_scaling_by_label_keeps_null_labels_and_other_columns(spark):
    from tessella.operators import scale

    cells = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), (None, 2.0, "z"), (None, 6.0, "w"), ("b", None, "v")], "s string, value double, note string")
    got = {r.note: r.value for r in scale.min_max_scale(cells, "s").collect()}
    assert got == {"x": 0.0, "y": 1.0, "z": 0.0, "w": 1.0, "v": 0.0}
    shares = {r.note: r.value for r in scale.normalize(cells, "s", "note", method="total").collect()}
    assert shares == {"x": 0.25, "y": 0.75, "z": 0.25, "w": 0.75, "v": None}
    soft = scale.softmax(cells, "s")
    assert soft.columns == cells.columns and abs(sum(r.value for r in soft.collect() if r.note in "xy") - 1) < 1e-12
    plan = soft._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_coverage_against_brute_force_without_pairs(spark):
    import random

    from tessella.operators import intervals

    rng = random.Random(5)
    side = lambda n, far: [(i, rng.choice("xyz"), s, s + rng.randrange(-2, far)) for i in range(n) for s in [rng.randrange(-20, 60)]]
    a, b = side(150, 30) + [(900, "w", 1, 5), (901, None, 1, 5), (902, "x", None, 5)], side(120, 12) + [(900, None, 1, 5), (901, "x", None, 3)]
    schema = "id long, chrom string, start long, end long"
    out = intervals.coverage(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert "_bin" not in out._jdf.queryExecution().analyzed().toString()
    for r, (i, c, s, e) in zip(sorted(out.collect(), key=lambda r: r.a_id), sorted(a), strict=True):
        real = [(p, q) for _, d, p, q in b if None not in (c, d, s, p) and c == d and min(q, e) > max(p, s)]
        places = {x for p, q in real for x in range(max(p, s), min(q, e))}
        assert (r.a_id, r.hits, r.covered) == (i, len(real), len(places))


def test_overlap_against_brute_force_with_copies(spark):
    rng = random.Random(9)
    make = lambda n, at: [(at + i if i % 9 else None, rng.choice("xy") if i % 20 else None, s, s + rng.choice([-1, 0, 1, 3, 9, 70])) for i in range(n) for s in [rng.randint(-30, 40)]]
    left, right = make(90, 0), make(80, 1000)
    left += [(i, "x", 5, 12) for i in range(200, 230)] + [(7, "x", 5, 12), (8, "x", None, 3), (8, "x", 3, None)]
    right += [(i, "x", 9, 30) for i in range(2000, 2025)] + [(2001, "x", 9, 30)]
    want = sorted((str(i), str(j), c, min(e, v) - max(s, u), (min(e, v) - max(s, u)) / (e - s), (min(e, v) - max(s, u)) / (v - u)) for i, c, s, e in left for j, d, u, v in right if None not in (c, d, s, e) and c == d and min(e, v) - max(s, u) >= 2)
    df = [spark.createDataFrame(r, "id long, chrom string, start long, end long").repartition(3) for r in (left, right)]
    own = lambda out: sorted((str(r.a_id), str(r.b_id), *r[2:]) for r in out.collect())
    assert own(intervals.overlap(*df, min_overlap=2, width=8)) == want
    bounded = intervals.overlapping(*df, min_overlap=2, width=8, most=4, side=40, fine=500)  # copies in parts, bins in cells
    assert bounded.select(F.max(F.size("a_ids"))).first()[0] < 30 and bounded.rdd.getNumPartitions() > 4
    assert own(intervals.by_row(bounded)) == want
    assert intervals.overlap(df[0].limit(0), df[1]).count() == 0


def test_overlap_of_copies_is_written_in_little_space(spark, tmp_path):
    sizes = []
    for n in (1, 8):
        a, b = (spark.range(1200 * n).selectExpr(f"id * {odd} as id", "concat('c', id % 3) as chrom", f"id * {step} % 1200 as start", f"id * {step} % 1200 + 9 + id % 12 as end") for odd, step in ((7919, 7), (6007, 11)))
        intervals.overlap(a, b).write.parquet(str(tmp_path / str(n)))
        sizes.append(sum(f.stat().st_size for f in (tmp_path / str(n)).glob("*.parquet")) / spark.read.parquet(str(tmp_path / str(n))).count())
    assert sizes[1] < sizes[0] / 8 and sizes[1] < 1  # bytes a row


def test_nearest_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "overlap", lambda *_, **__: pytest.fail("all overlapping pairs are made"))
    rng = random.Random(4)
    make = lambda n, at: [(at + i, rng.choice("xyz") if i % 20 else None, s, s + rng.choice([0, 1, 1, 2, 7, 40, 300, 1 << 40])) for i in range(n) for s in [rng.randint(-400, 400)]]
    left, right = make(150, 0), [(i, c if c != "z" else "w", s, e) for i, c, s, e in make(120, 1000)]
    right += [(i + 500, c, s, e) for i, c, s, e in right[:40]]
    df = [spark.createDataFrame(r, "id long, chrom string, start long, end long").repartition(3) for r in (left, right)]
    want = {}
    for i, c, s, e in left:
        found = []
        for j, d, u, v in right:
            if c == d and c is not None:
                found += [(0, j)] if min(e, v) > max(s, u) else []
                found += [(s - v, j)] if v <= s else []
                found += [(u - e, j)] if u >= e else []
        if found:
            want[i] = min(found)
    got = {r.a_id: (r.distance, r.b_id) for r in intervals.nearest(*df).collect() if left[r.a_id][1] is not None}
    assert got == want
    assert intervals.nearest(df[0], df[1].limit(0)).count() == 0 == intervals.nearest(df[0].limit(0), df[1]).count()


def test_protein_letters_are_counted_in_one_pass(spark):
    from tessella.operators import proteins

    texts = ["MKWVTF", "mkwvtf ccc", "", None, "É straße Ω K", "BJOUXZ", "ARNDCEQGHILKMFPSTWYV" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, s string").repartition(3)
    got = proteins.protein_properties(df, "id", "s")
    assert "regexp" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.key: r for r in got.collect()}
    for i, t in enumerate(texts):
        r, c = rows[i], {a: sum(x in (a, a.lower()) for x in t) for a in proteins.MASSES} if t is not None else None
        if c is None:
            assert tuple(r)[1:] == (None,) * 6
            continue
        size = sum(c.values())
        assert (r.length, r.charge, r.extinction) == (size, c["K"] + c["R"] - c["D"] - c["E"], c["W"] * 5500 + c["Y"] * 1490 + c["C"] // 2 * 125)
        assert math.isclose(r.mass, sum(c[a] * v for a, v in proteins.MASSES.items()) + 18.0153)
        want = (sum(c[a] * v for a, v in proteins.HYDROPATHY.items()) / size, (c["F"] + c["W"] + c["Y"]) / size) if size else (None, None)
        assert (r.gravy, r.aromaticity) == want if not size else all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip((r.gravy, r.aromaticity), want, strict=True))


def test_moments_name_a_cleaned_value_once(spark):
    from tessella.operators import hypotheses

    rows = [(i % 2, float(i * i % 31) if i % 9 else float("nan")) for i in range(90)]
    got = hypotheses.normality(spark.createDataFrame(rows, "f long, x double"), ["f"], "x")
    sums = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x]
    assert sums and not any("isnan" in x.lower() for x in sums)  # else every moment works it out again, row by row
    for r in got.collect():
        x = [v for f, v in rows if f == r.f and v == v]
        m = sum(x) / len(x)
        m2, m3, m4 = (sum((v - m) ** k for v in x) / len(x) for k in (2, 3, 4))
        assert r.n == len(x) and math.isclose(r.skewness, m3 / m2**1.5, abs_tol=1e-9) and math.isclose(r.kurtosis, m4 / m2**2, abs_tol=1e-9)


def test_shipments_are_summed_by_order_before_they_are_shuffled(spark, tmp_path):
    from tessella.plans.fixtures import intervals as tables

    order = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"
    day = lambda n: datetime.datetime(2000, 1, n)
    spark.createDataFrame([(1, 1, day(1), "x"), (1, 1, day(2), "x"), (1, 2, day(1), "x"), (2, 21, day(3), "y"), (3, 1, day(1), "x")], order).write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 4.0, day(9)), (1, 7.5, day(8)), (2, 3.0, day(5)), (4, 9.0, day(1)), (None, 2.0, day(1))]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = tables(spark, str(tmp_path))[1]
        plan = b._jdf.queryExecution().executedPlan().toString().split("\n")
        got = sorted(tuple(r) for r in b.select("id", "chrom", "start", "end").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    first = (datetime.date(2000, 1, 8) - datetime.date(1970, 1, 1)).days
    assert got == [(1, "x-1", first, first + 8), (1, "x-2", first, first + 8), (2, "y-1", first - 3, first + 1)]
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "l_shipdate" in line)
    shuffle = max(i for i, line in enumerate(plan[:scan]) if "Exchange" in line)
    assert any("partial_min" in line for line in plan[shuffle:scan])  # one row an order and task goes through the shuffle

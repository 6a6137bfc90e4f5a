import math

from pyspark.sql import functions as F

from tessella.operators import contingency as C
from tessella.operators import ranks as R


def test_ordered_groups_by_pairs(spark):
    data = [("f", g, v) for g, vs in {"a": [1.0, 2.0, 2.0], "b": [2.0, 3.0, 5.0], "c": [4.0, 5.0, 9.0, None]}.items() for v in vs]
    got = R.jonckheere(spark.createDataFrame(data, "f string, g string, v double"), ["f"], "g", "v", ["a", "b", "c"]).first()
    of = lambda g: [v for _, h, v in data if h == g and v is not None]
    want = sum((x < y) + (x == y) / 2 for a, b in ("ab", "ac", "bc") for x in of(a) for y in of(b))
    assert (got.j, got.n) == (want, 9) and got.z > 0


def test_pettitt_finds_the_step(spark):
    df = spark.createDataFrame([("k", i, float(i % 3 + (10 if i >= 12 else 0))) for i in range(30)] + [("one", 0, 1.0)], "k string, i int, v double")
    got = {r["key"]: r for r in R.pettitt(df, "k", ["i"], "v").collect()}
    assert got["k"]["at"] == 12 and got["k"].p < 0.01 and got["one"].k == 0


def test_partial_acf_solves_yule_walker(spark):
    import numpy as np

    r = [0.6, 0.2, -0.3]
    got = {x.lag: x.pacf for x in R.partial_acf(spark.createDataFrame([("k", i + 1, v) for i, v in enumerate(r)], "key string, lag int, acf double"), 3).collect()}
    for k in (1, 2, 3):
        m = np.array([[1.0 if i == j else r[abs(i - j) - 1] for j in range(k)] for i in range(k)])
        assert math.isclose(got[k], np.linalg.solve(m, r[:k])[-1])


def test_agreement_of_equal_and_empty_ratings(spark):
    same = spark.createDataFrame([(u, r, float(u)) for u in range(4) for r in range(3)] + [(9, 0, 1.0)], "u int, r int, v double")
    assert R.krippendorff(same, "u", "v").first().alpha == 1 and R.krippendorff(same, "u", "v", "interval").first().units == 4
    assert R.intraclass(same, "u", "r", "v", 3).first().agreement_single == 1
    none = same.where("false")
    assert R.krippendorff(none, "u", "v").first().alpha is None
    assert R.intraclass(none, "u", "r", "v", 3).collect() == []
    assert R.morisita(none, "u", "v", 3).collect() == []
    assert C.clustering_scores(none, "u", "r").collect() == []
    assert [r.n for r in C.confusion(none, "u", "r").collect()] == [0, 0, 0, 0]
    s = C.clustering_scores(same, "u", "u").first()
    assert (s.homogeneity, s.adjusted_rand, s.fowlkes_mallows, round(s.variation_of_information, 12)) == (1, 1, 1, 0)
    assert R.ansari_bradley(none.withColumn("g", F.lit("a")), ["u"], "g", "v", "a", "b").collect() == []

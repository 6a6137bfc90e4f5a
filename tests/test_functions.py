import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import distributions as D
from tessella.operators.enrichment import enrich


def test_incomplete_functions():
    assert D.beta_regularised(2, 3, 0.5) == pytest.approx(0.6875)
    assert D.beta_regularised(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5))
    assert D.beta_regularised([1, 1], [1, 4], [0.0, 1.0]).tolist() == [0, 1]
    assert D.gamma_upper(1, [0.5, 3.0, 0.0]) == pytest.approx([math.exp(-0.5), math.exp(-3), 1])
    assert D.gamma_upper(0.5, 2.0) == pytest.approx(math.erfc(math.sqrt(2)))
    k = np.arange(5)
    assert D.gamma_upper(5, 4.2) == pytest.approx(sum(math.exp(-4.2) * 4.2**i / math.factorial(i) for i in k))


def test_tails(spark):
    from tessella.session import ship

    ship(spark)
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    row = df.select(
        D.normal_sf(F.lit(1.959963984540054)).alias("z"), D.chi2_sf(F.lit(3.841458820694124), F.lit(1)).alias("chi"), D.t_two_sided(F.lit(2.2281388519649385), F.lit(10)).alias("t"),
        D.f_sf(F.lit(3.4028261053501945), F.lit(3), F.lit(21)).alias("f"), D.binomial_two_sided(F.lit(7), F.lit(10), F.lit(0.5)).alias("b"), D.hypergeometric_sf(F.lit(3), F.lit(10), F.lit(5), F.lit(4)).alias("h"), D.chi2_sf(F.lit(None), F.lit(1)).alias("n"),
    ).first()
    assert row.z == pytest.approx(0.025) and row.chi == pytest.approx(0.05) and row.t == pytest.approx(0.05)
    assert row.b == pytest.approx(0.34375) and row.h == pytest.approx((10 * 5 + 5) / 210)
    # the F tail against the t tail
    two = df.select(D.f_sf(F.lit(2.5**2), F.lit(1), F.lit(9)).alias("f"), D.t_two_sided(F.lit(2.5), F.lit(9)).alias("t")).first()
    assert two.f == pytest.approx(two.t) and (row.n is None or math.isnan(row.n))


def test_enrichment(spark):
    universe = spark.createDataFrame([(g, t) for g in range(10) for t in ("x", "y") if t == "x" and g < 5 or t == "y"], "gene long, term string")
    rows = {r.term: r for r in enrich(spark.createDataFrame([(0,), (1,), (2,), (9,), (77,)], "gene long"), universe, "gene", "term").collect()}
    assert (rows["x"].hits, rows["x"].size, rows["x"].drawn, rows["x"].total) == (3, 5, 4, 10) and rows["x"].p == pytest.approx(55 / 210) and rows["y"].p == pytest.approx(1)


def test_poisson_sql_and_tail_at_large_means(spark):
    import duckdb

    from tessella.functions.distributions import gamma_upper
    from tessella.plans.tails import poisson_cdf

    for mean, k in ((960.0, 930), (5760.0, 5800), (40000.0, 40100)):
        terms = [math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k + 1)]
        want = math.fsum(terms)
        assert abs(duckdb.connect().execute(f"SELECT {poisson_cdf('k', 'mean')} FROM (SELECT {k} AS k, {mean}::DOUBLE AS mean)").fetchone()[0] - want) < 1e-9
        assert abs(gamma_upper(k + 1.0, mean) - want) < 1e-9

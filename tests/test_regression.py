import numpy as np
import pytest

from tessella.operators import regression as R

SCHEMA = "k int, x double, z double, y double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=60), rng.normal(size=60)
    y = 1 + 2 * x - z + rng.normal(size=60)
    data = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))]
    return spark.createDataFrame([*data, (60, None, 1.0, 2.0), (61, float("nan"), 1.0, 2.0), (62, 1.0, 2.0, None)], SCHEMA), np.column_stack([np.ones(60), x, z]), y


def test_two_regressors_against_numpy(rows):
    df, design, y = rows
    b, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    inverse = np.linalg.inv(design.T @ design)
    got = R.regress(df, "y", ["x", "z"]).collect()
    assert np.allclose([r.estimate for r in got], b)
    assert np.allclose([r.std_error for r in got], np.sqrt(rss[0] / 57 * np.diag(inverse)))
    hat = np.einsum("ij,jk,ik->i", design, inverse, design)
    inf = R.influence(df, "k", "y", ["x", "z"]).orderBy("key").collect()
    assert len(inf) == 60  # rows with a missing term are left out
    assert np.allclose([r.leverage for r in inf], hat)
    for i in (0, 7):  # a fit without the row
        keep = np.arange(60) != i
        bi = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
        left = ((y[keep] - design[keep] @ bi) ** 2).sum() / 56
        assert np.isclose(inf[i].press_residual, y[i] - design[i] @ bi)
        assert np.isclose(inf[i].dfbetas_z, (b - bi)[2] / np.sqrt(left * inverse[2, 2]))
        assert np.isclose(inf[i].cooks_distance, ((design @ (b - bi)) ** 2).sum() / 3 / (rss[0] / 57))


def test_glm_score_is_zero(rows, spark):
    df, design, y = rows
    hit = df.selectExpr("x", "z", "cast(y > 1 as int) as y").where("y is not null")
    b = np.array([r.estimate for r in R.glm(hit, "y", ["x", "z"]).collect()])
    assert np.allclose(design.T @ ((y > 1) - 1 / (1 + np.exp(-design @ b))), 0, atol=1e-8)


def test_no_rows_and_no_spread_give_no_numbers(rows, spark):
    df, *_ = rows
    flat = spark.createDataFrame([(i, 1.0, 1.0, float(i)) for i in range(5)], SCHEMA)
    for t in (df.where("false"), flat):
        assert all(r.estimate is None for r in R.regress(t, "y", ["x"]).collect())
        assert R.breusch_pagan(t, "y", ["x"]).first().chi2 is None
        assert R.chow(t, "y", ["x"], "k", 0, 1).first().f is None
        assert [r.vif for r in R.vif(t, ["x", "z"]).collect()] == [None, None]
        assert R.partial_correlation(t, "x", "y", ["z"]).first().r is None
        assert all(r.distance2 is None or r.distance2 != r.distance2 for r in R.mahalanobis(t, "k", ["x", "z"]).collect())
        R.influence(t, "k", "y", ["x"]).collect()
    assert all(r.estimate is None for r in R.glm(df.where("false"), "y", ["x"]).collect())

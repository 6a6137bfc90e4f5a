import math

import numpy as np

from tessella.operators.cox import cox_regression


def loglik(beta, time, event, x, w):
    """Efron's partial likelihood, by the definition."""
    r, total = w * np.exp(x @ beta), 0.0
    for t in np.unique(time[event]):
        dead, risk = event & (time == t), time >= t
        d = dead.sum()
        total += (w[dead] * (x[dead] @ beta)).sum() - w[dead].mean() * sum(math.log(r[risk].sum() - k / d * r[dead].sum()) for k in range(d))
    return total


def made(n=150, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.standard_normal(n), rng.integers(0, 2, n) * 10.0])
    time = np.ceil(rng.exponential(8 / np.exp(0.5 * x[:, 0] - 0.03 * x[:, 1])))
    return x, time, rng.random(n) < 0.7, rng.integers(1, 4, n).astype(float)


def check(row_of, x, time, event, w):
    beta = np.array([row_of[c].coef for c in ("a", "b")])
    top, h = loglik(beta, time, event, x, w), 1e-4
    scale = np.array([1.0, 10.0])
    hess = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            e, f = np.eye(2)[i] * h / scale[i], np.eye(2)[j] * h / scale[j]
            hess[i, j] = (loglik(beta + e + f, time, event, x, w) - loglik(beta + e - f, time, event, x, w) - loglik(beta - e + f, time, event, x, w) + loglik(beta - e - f, time, event, x, w)) / (4 * h * h / scale[i] / scale[j])
        slope = (loglik(beta + e, time, event, x, w) - loglik(beta - e, time, event, x, w)) / (2 * h)
        assert abs(slope) < 1e-4
    se = np.sqrt(np.diag(np.linalg.inv(-hess)))
    for c, s in zip(("a", "b"), se, strict=True):
        r = row_of[c]
        assert abs(r.se / s - 1) < 1e-4 and abs(r.z - r.coef / r.se) < 1e-9 and abs(r.hr - math.exp(r.coef)) < 1e-12
        assert abs(r.p - math.erfc(abs(r.z) / 2**0.5)) < 1e-9 and abs(r.ci_low - math.exp(r.coef - 1.959964 * r.se)) < 1e-6
        assert abs(r.log_likelihood - top) < 1e-8 * abs(top) and abs(r.aic - (4 - 2 * top)) < 1e-6
        assert (r.n, r.events) == (len(time), event.sum())


def test_cox_equals_the_definition(spark):
    x, time, event, w = made()
    rows = [(float(a), float(b), float(t), int(e), float(v)) for (a, b), t, e, v in zip(x, time, event, w, strict=True)]
    rows += [(None, 1.0, 3.0, 1, 1.0), (1.0, float("nan"), 3.0, 1, 1.0), (1.0, 1.0, 0.0, 1, 1.0), (1.0, 1.0, -2.0, 1, 1.0), (1.0, 1.0, None, 1, 1.0), (1.0, 1.0, 3.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, time double, event int, w double").repartition(4)
    check({r.covariate: r for r in cox_regression(df, "time", "event", ["a", "b"]).collect()}, x, time, event, np.ones(len(x)))
    check({r.covariate: r for r in cox_regression(df, "time", "event", ["a", "b"], weight="w").collect()}, x, time, event, w)


def test_levels_and_fits_without_numbers(spark):
    x, time, event, _ = made(80)
    rows = [(float(a), "ABC"[i % 3], float(t), bool(e)) for i, ((a, _), t, e) in enumerate(zip(x, time, event, strict=True))]
    df = spark.createDataFrame(rows, "a double, g string, time double, event boolean").selectExpr("a", "g", "time", "int(event) as event")
    got = cox_regression(df, "time", "event", ["a", "g"], categorical=("g",)).collect()
    assert [r.covariate for r in got] == ["a", "g_B", "g_C"] and all(r.coef is not None for r in got)
    assert cox_regression(df.withColumn("one", df.a * 0), "time", "event", ["one"]).first().coef is None
    assert cox_regression(df.selectExpr("a", "time", "0 as event"), "time", "event", ["a"]).first().coef is None
    assert cox_regression(df.limit(0), "time", "event", ["a"]).first().coef is None
    apart = spark.createDataFrame([(1.0, 1.0, 1), (1.0, 2.0, 1), (0.0, 9.0, 0), (0.0, 9.0, 0)], "a double, time double, event int")
    assert cox_regression(apart, "time", "event", ["a"]).first().coef is None


def test_rows_are_read_once(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), int(t), int(e)) for a, t, e in zip(rng.normal(size=80), rng.integers(0, 12, 80), rng.integers(0, 2, 80), strict=True)]
    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (read.add(1), r)[1]), "a double, time long, event long")
    r = cox_regression(df, "time", "event", ["a"]).first()
    assert r.n == sum(t > 0 for _, t, _ in rows) and r.coef is not None
    assert read.value == len(rows)

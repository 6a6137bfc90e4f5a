"""A linear model with a random intercept, by restricted or full maximum likelihood.

Rows are summed once by group; what the likelihood needs of a group are its size and sums of products. Each pass over the
groups weighs them for a grid of 33 variance ratios, and the driver narrows the grid around the best: a few passes, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.distributions import normal_sf
from tessella.operators.common import clean, materialized
from tessella.operators.cox import dummies
from tessella.session import ship

_GRID, _LOW, _HIGH, _LEVELS = 33, -20.0, 20.0, 4


def linear_mixed_model(rows: DataFrame, y: str, x: list[str], group: str, categorical: tuple[str, ...] = (), reml: bool = True) -> DataFrame:
    """term, estimate, se, z, p, ci_low, ci_high of the intercept and the fixed effects, then as estimates alone group_var,
    residual_var, icc, n_groups, n_obs.

    Rows with a missing value are left out. The ratio of group to residual variance is sought between e^-20 and e^20, and
    0 where no ratio does better; se are those of generalised least squares at the ratio found. Fewer than two groups, no more rows than
    terms and one, or terms that depend on one another, give no numbers.
    """
    spark = rows.sparkSession
    ship(spark)
    t, names = dummies(rows, x, list(categorical))
    terms, size = ["intercept", *names], len(names) + 2
    t = t.select(F.col(group).alias("g"), *[clean(c).alias(f"_v{i}") for i, c in enumerate(names)], clean(y).alias("_y")).dropna()
    cols = [F.lit(1.0), *[F.col(f"_v{i}") for i in range(len(names))], F.col("_y")]
    means = [0.0, *[m if m is not None else 0.0 for m in t.agg(*[F.avg(c) for c in cols[1:]]).first()]]
    cols = [cols[0], *[c - F.lit(float(m)) for c, m in zip(cols[1:], means[1:], strict=True)]]  # less their means, which only moves the intercept
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    groups = materialized(t.groupBy("g").agg(F.array(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).alias("m")))
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def weighed(ratios: list[float]) -> np.ndarray:
        """By ratio: groups, rows, the sum of log(1 + ratio n), and the weighted products."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lam, out = np.array(ratios)[:, None], np.zeros((len(ratios), 3 + len(pairs)))
            for batch in batches:
                m = batch["m"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(pairs))
                n, first = m[:, 0], m[:, :size]
                k = lam / (1 + lam * n)
                out[:, 0] += len(n)
                out[:, 1] += n.sum()
                out[:, 2] += np.log1p(lam * n).sum(axis=1)
                out[:, 3:] += m.sum(axis=0) - k @ (first[:, a] * first[:, b])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

        got = groups.select("m").mapInArrow(task, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # numbers of the fit
        v = np.zeros(len(ratios) * (3 + len(pairs)))
        for r in got:
            v[r["k"]] = r["v"]
        return v.reshape(len(ratios), -1)

    def fit(v: np.ndarray):
        n, s = v[1], np.zeros((size, size))
        s[a, b] = s[b, a] = v[3:]
        xx, xy = s[:-1, :-1], s[:-1, -1]
        beta = np.linalg.solve(xx, xy)
        rss = float(s[-1, -1] - xy @ beta)
        free = n - (size - 1 if reml else 0)
        value = v[2] + free * math.log(max(rss, 1e-300)) + (np.linalg.slogdet(xx)[1] if reml else 0)
        return value, beta, np.linalg.inv(xx), rss / free

    nothing = [(c, None, None) for c in terms]
    start = weighed([0.0])[0]
    n_groups, n = start[0], start[1]
    tail = lambda g, r: [("group_var", g, None), ("residual_var", r, None), ("icc", g / (g + r) if g is not None and g + r > 0 else None, None), ("n_groups", float(n_groups), None), ("n_obs", float(n), None)]
    s = np.zeros((size, size))
    s[a, b] = s[b, a] = start[3:]
    if n_groups < 2 or n <= size or np.linalg.matrix_rank(s[:-1, :-1]) < size - 1:
        return _table(spark, nothing + tail(None, None))
    best = (fit(start), 0.0)
    low, high = _LOW, _HIGH
    for _ in range(_LEVELS + 1):
        at = np.linspace(low, high, _GRID)
        fits = [fit(v) for v in weighed(np.exp(at).tolist())]
        k = int(np.argmin([f[0] for f in fits]))
        step = at[1] - at[0]
        low, high = at[k] - step, at[k] + step
    where = float(at[k])
    if 0 < k < _GRID - 1:  # the vertex of the parabola through the best and its neighbours
        p, q, r = (fits[i][0] for i in (k - 1, k, k + 1))
        if p + r - 2 * q > 0:
            where += step * (p - r) / (2 * (p + r - 2 * q))
    end = fit(weighed([math.exp(where)])[0])
    if fits[k][0] < best[0][0] - 1e-9 * abs(best[0][0]):
        best = (end, math.exp(where))
    (_, beta, inverse, residual), ratio = best
    move = np.array(means[:-1])
    beta = beta.copy()
    shift = np.zeros(size - 1)
    shift[0] = 1.0
    shift[1:] = -move[1:]
    beta[0] = means[-1] + shift @ beta
    variances = np.diag(inverse) * residual
    variances = np.append(shift @ inverse @ shift * residual, variances[1:])
    return _table(spark, [(c, float(e), float(math.sqrt(v))) for c, e, v in zip(terms, beta, variances, strict=True)] + tail(float(ratio * residual), float(residual)))


def _table(spark, data: list[tuple]) -> DataFrame:
    out = spark.createDataFrame(data, "term string, estimate double, se double")  # a row for each term
    z, half = F.when(F.col("se") > 0, F.col("estimate") / F.col("se")), F.lit(1.959963984540054) * F.col("se")
    return out.withColumn("z", z).withColumn("p", F.when(F.col("z").isNotNull(), F.least(2 * normal_sf(F.abs("z")), F.lit(1.0)))).withColumn("ci_low", F.col("estimate") - half).withColumn("ci_high", F.col("estimate") + half)

"""Ridge, lasso and elastic net on cross-products: one pass sums them by fold; every fit and every fold's complement, by
subtraction, is then coordinate descent on a matrix as large as the number of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean
from tessella.session import ship


def _moments(rows: DataFrame, y: str, x: list[str], fold: Column, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """The means of x and y, and by fold the sums of products of (1, x, y) less these means; missing x take their mean."""
    keep = rows.where(clean(y).isNotNull() & fold.isNotNull())
    got = keep.agg(*[F.avg(clean(c)) for c in [*x, y]]).first()
    means, size = np.array([v if v is not None else 0.0 for v in got]), len(x) + 2
    slim = keep.select(fold.cast("int").alias("fold"), *[F.coalesce(clean(c) - F.lit(float(m)), F.lit(0.0)).alias(f"_v{i}") for i, (c, m) in enumerate(zip([*x, y], means, strict=True))])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, size, size))
        for batch in batches:
            v = np.column_stack([np.ones(batch.num_rows), *[batch[f"_v{i}"].to_numpy() for i in range(size - 1)]])
            f = batch["fold"].to_numpy()
            for k in np.unique(f):
                sums[k] += v[f == k].T @ v[f == k]
        some = np.flatnonzero(sums[:, 0, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums[some].reshape(len(some), -1)), pa.list_(pa.float64()))], ["fold", "m"])

    ship(rows.sparkSession)
    parts = slim.mapInArrow(products, "fold int, m array<double>")
    out = np.zeros((folds, size * size))
    # one number for each fold and pair of features
    for r in parts.select("fold", F.posexplode("m").alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v")).collect():
        out[r["fold"], r["k"]] = r["v"]
    return means, out.reshape(folds, size, size)


def _solve(m: np.ndarray, alpha: float, l1_ratio: float | None, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of standardised features, slopes and intercept of the features less their means. l1_ratio None: ridge."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    sd[sd <= 1e-12] = 0
    inv = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    c, g = cov[:-1, -1] * inv, cov[:-1, :-1] * np.outer(inv, inv)
    used = sd > 0
    w = np.zeros(len(sd))
    if l1_ratio is None:
        w[used] = np.linalg.solve(g[np.ix_(used, used)] + alpha / n * np.eye(used.sum()), c[used])
    else:
        soft, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
        for _ in range(rounds):
            old = w.copy()
            for j in np.flatnonzero(used):
                v = c[j] - g[j] @ w + g[j, j] * w[j]
                w[j] = np.sign(v) * max(abs(v) - soft, 0) / (g[j, j] + ridge)
            if np.abs(w - old).max(initial=0) <= tolerance * max(1.0, np.abs(w).max(initial=0)):
                break
    slopes = w * inv
    return w, slopes, float(mean[-1] - mean[:-1] @ slopes)


def _r2(m: np.ndarray, slopes: np.ndarray, intercept: float) -> float:
    """Of the rows summed in m."""
    v = np.concatenate([[-intercept], -slopes, [1.0]])
    total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return float(1 - v @ m @ v / total) if total > 0 else float("nan")


def penalised(rows: DataFrame, key: str, y: str, x: list[str], alpha: float, l1_ratio: float | None, folds: int = 5, fold: Column | None = None, rounds: int = 100_000, tolerance: float = 1e-12) -> DataFrame:
    """By feature: coef (of the standardised feature), slope, and of the fit intercept, n, cv_mean and cv_std (of the folds' r2).

    Minimises |y - Xw|^2 / 2n + alpha (l1_ratio |w| + (1 - l1_ratio) |w|^2 / 2), or for ridge (l1_ratio None) |y - Xw|^2 +
    alpha |w|^2. A missing feature takes its mean over all rows with y; rows without y are left out; a feature without spread gets 0. Folds
    are dealt by a hash of the key, or by `fold` (0 to folds - 1); each is scored by the fit on the others.
    """
    deal = fold if fold is not None else F.pmod(F.xxhash64(key), F.lit(folds))
    means, m = _moments(rows, y, x, deal, folds)
    whole = m.sum(axis=0)
    schema = "feature string, coef double, slope double, intercept double, n long, cv_mean double, cv_std double"
    if not whole[0, 0]:
        return rows.sparkSession.createDataFrame([], schema)
    w, slopes, a = _solve(whole, alpha, l1_ratio, rounds, tolerance)
    scores = [_r2(m[k], *_solve(whole - m[k], alpha, l1_ratio, rounds, tolerance)[1:]) for k in range(folds) if m[k, 0, 0] and whole[0, 0] > m[k, 0, 0]]
    scores = [s for s in scores if np.isfinite(s)]
    cv = (float(np.mean(scores)), float(np.std(scores))) if scores else (None, None)
    intercept = a + float(means[-1] - means[:-1] @ slopes)
    return rows.sparkSession.createDataFrame([(f, float(c), float(s), intercept, int(whole[0, 0]), *cv) for f, c, s in zip(x, w, slopes, strict=True)], schema)


def ridge(rows: DataFrame, key: str, y: str, x: list[str], alpha: float = 1.0, **more) -> DataFrame:
    return penalised(rows, key, y, x, alpha, None, **more)


def lasso(rows: DataFrame, key: str, y: str, x: list[str], alpha: float = 0.001, **more) -> DataFrame:
    return penalised(rows, key, y, x, alpha, 1.0, **more)


def elastic_net(rows: DataFrame, key: str, y: str, x: list[str], alpha: float = 1.0, l1_ratio: float = 0.5, **more) -> DataFrame:
    return penalised(rows, key, y, x, alpha, l1_ratio, **more)

"""Linear and generalised linear models of few regressors: Spark sums the moments (one number for each pair of terms), the
driver solves a system as large as the number of terms, and results by row are plain expressions with the fit as constants.

Rows with a missing value in any term are left out. A fit without spread, or with fewer rows than terms, gives no numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.distributions import chi2_sf, f_sf, normal_sf, t_two_sided
from tessella.operators.common import clean


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are finite, as doubles."""
    out = rows
    for c in columns:
        out = out.withColumn(c, clean(c))
    return out.dropna(subset=list(columns))


def covariances(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and the sample covariance matrix, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = complete(rows, *columns).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a, b in pairs]).first()
    n, size = got[0], len(columns)
    value = lambda x: math.nan if x is None else x
    cov = np.empty((size, size))
    for (a, b), x in zip(pairs, got[1 + size :], strict=True):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = value(x)
    return n, np.array([value(x) for x in got[1 : 1 + size]]), cov


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse; not a number where there is none."""
    if not np.isfinite(matrix).all() or np.linalg.matrix_rank(matrix) < len(matrix):
        return np.full(matrix.shape, math.nan)
    return np.linalg.inv(matrix)


def _number(x: float) -> float | None:
    return float(x) if math.isfinite(x) else None


@dataclass
class Fit:
    """Least squares with an intercept: coefficients of `x`, the inverse of their centred cross-products, residual squares."""

    x: list[str]
    y: str
    n: int
    means: np.ndarray
    slopes: np.ndarray
    inverse: np.ndarray
    rss: float
    total: float

    @property
    def terms(self) -> int:
        return len(self.x) + 1

    @property
    def intercept(self) -> float:
        return self.means[-1] - self.means[:-1] @ self.slopes

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.total if self.total > 0 else math.nan

    def residual(self) -> Column:
        return F.col(self.y) - F.lit(float(self.intercept)) - sum(F.col(c) * F.lit(float(b)) for c, b in zip(self.x, self.slopes, strict=True))

    def _centred(self) -> list[Column]:
        return [F.col(c) - F.lit(float(m)) for c, m in zip(self.x, self.means, strict=False)]

    def pull(self, j: int) -> Column:
        """How a row pulls slope j: row j of the inverse times its centred regressors."""
        return sum(F.lit(float(w)) * c for w, c in zip(self.inverse[j], self._centred(), strict=True))

    def leverage(self) -> Column:
        return F.lit(1 / max(self.n, 1)) + sum(c * self.pull(j) for j, c in enumerate(self._centred()))


def fit(rows: DataFrame, y: str, x: list[str]) -> Fit:
    n, means, cov = covariances(rows, [*x, y])
    inverse = _inverse(cov[:-1, :-1] * (n - 1))
    slopes = inverse @ (cov[:-1, -1] * (n - 1))
    total = cov[-1, -1] * (n - 1)
    return Fit(x, y, n, means, slopes, inverse, float(total - slopes @ cov[:-1, -1] * (n - 1)), float(total))


def _table(rows: DataFrame, data: list[tuple], schema: str) -> DataFrame:
    return rows.sparkSession.createDataFrame(data, schema)  # one row for each term


def regress(rows: DataFrame, y: str, x: list[str]) -> DataFrame:
    """term, estimate, std_error, t, p of ordinary least squares."""
    f = fit(rows, y, x)
    df = f.n - f.terms
    s2 = f.rss / df if df > 0 else math.nan
    m = f.means[:-1]
    variances = [s2 * (1 / f.n + m @ f.inverse @ m) if f.n else math.nan, *[s2 * f.inverse[j, j] for j in range(len(x))]]
    rows_ = [(t, _number(b), _number(v**0.5) if v >= 0 else None, df) for t, b, v in zip(["intercept", *x], [f.intercept, *f.slopes], variances, strict=True)]
    t = F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error"))
    return _table(rows, rows_, "term string, estimate double, std_error double, df long").withColumn("t", t).withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def influence(rows: DataFrame, key: str, y: str, x: list[str]) -> DataFrame:
    """By row: residual, leverage, standardised and studentised residuals, Cook's distance, DFFITS, covariance ratio, the
    residual of prediction (its squares sum to PRESS) and DFBETAS of each slope."""
    f = fit(rows, y, x)
    n, k = f.n, f.terms
    t = complete(rows, y, *x).select(F.col(key).alias("key"), f.residual().alias("residual"), f.leverage().alias("leverage"), *[f.pull(j).alias(f"_c{j}") for j in range(len(x))])
    e, h, free = F.col("residual"), F.col("leverage"), 1 - F.col("leverage")
    ok = lambda c: F.when((free > 1e-12) & F.lit(n > k + 1), c)
    rss, df = F.lit(f.rss), max(n - k, 1)
    left = (rss - e * e / free) / max(df - 1, 1)  # variance without the row
    t = t.withColumn("standardized", ok(e / F.sqrt(rss / df * free))).withColumn("studentized", ok(F.when(left > 0, e / F.sqrt(left * free))))
    t = t.withColumn("cooks_distance", F.col("standardized") ** 2 * h / free / k).withColumn("dffits", F.col("studentized") * F.sqrt(h / free))
    t = t.withColumn("covratio", ok(1 / (free * ((df - 1 + F.col("studentized") ** 2) / df) ** k))).withColumn("press_residual", ok(e / free))
    for j, c in enumerate(x):
        t = t.withColumn(f"dfbetas_{c}", ok(F.when(left > 0, F.col(f"_c{j}") * e / free / F.sqrt(left * F.lit(float(f.inverse[j, j]))))))
    return t.drop(*[f"_c{j}" for j in range(len(x))])


def _chi(rows: DataFrame, value: float, df: int) -> DataFrame:
    return _table(rows, [(_number(value), df)], "chi2 double, df long").withColumn("p", chi2_sf(F.col("chi2"), F.col("df")))


def _f(rows: DataFrame, value: float, df1: int, df2: int) -> DataFrame:
    return _table(rows, [(_number(value), df1, df2)], "f double, df1 long, df2 long").withColumn("p", f_sf(F.col("f"), F.col("df1"), F.col("df2")))


def breusch_pagan(rows: DataFrame, y: str, x: list[str]) -> DataFrame:
    """Koenker's form: rows times the R² of squared residuals on the regressors."""
    f = fit(rows, y, x)
    second = fit(complete(rows, y, *x).withColumn("_e2", f.residual() ** 2), "_e2", x)
    return _chi(rows, f.n * second.r2, len(x))


def white(rows: DataFrame, y: str, x: list[str]) -> DataFrame:
    """The same on the regressors, their squares and products."""
    f = fit(rows, y, x)
    t, names = complete(rows, y, *x).withColumn("_e2", f.residual() ** 2), list(x)
    for i, a in enumerate(x):
        for j in range(i, len(x)):
            t, names = t.withColumn(f"_w{i}_{j}", F.col(a) * F.col(x[j])), [*names, f"_w{i}_{j}"]
    return _chi(rows, f.n * fit(t, "_e2", names).r2, len(names))


def reset(rows: DataFrame, y: str, x: list[str], powers: tuple[int, ...] = (2,)) -> DataFrame:
    """Ramsey's: F of powers of the fitted values added to the regressors."""
    f = fit(rows, y, x)
    t = complete(rows, y, *x).withColumn("_fit", F.col(y) - f.residual())
    for k in powers:
        t = t.withColumn(f"_p{k}", F.col("_fit") ** k)
    wide = fit(t, y, [*x, *[f"_p{k}" for k in powers]])
    df2 = f.n - wide.terms
    return _f(rows, (f.rss - wide.rss) / len(powers) / (wide.rss / df2) if df2 > 0 and wide.rss > 0 else math.nan, len(powers), df2)


def chow(rows: DataFrame, y: str, x: list[str], group: str, a, b) -> DataFrame:
    """F of one fit for groups a and b against a fit for each."""
    two = rows.where(F.col(group).isin(a, b))
    whole, one, other = fit(two, y, x), fit(two.where(F.col(group) == a), y, x), fit(two.where(F.col(group) == b), y, x)
    k, apart = whole.terms, one.rss + other.rss
    df2 = whole.n - 2 * k
    return _f(rows, (whole.rss - apart) / k / (apart / df2) if df2 > 0 and apart > 0 else math.nan, k, df2)


def vif(rows: DataFrame, x: list[str]) -> DataFrame:
    """Variance inflation of each regressor: the diagonal of the inverse correlation matrix."""
    _, _, cov = covariances(rows, x)
    sd = np.sqrt(np.diag(cov))
    return _table(rows, [(c, _number(v)) for c, v in zip(x, np.diag(_inverse(cov / np.outer(sd, sd))), strict=True)], "term string, vif double")


def partial_correlation(rows: DataFrame, x: str, y: str, given: list[str]) -> DataFrame:
    """Correlation of x and y with `given` held, its t and p."""
    n, _, cov = covariances(rows, [x, y, *given])
    inverse, df = _inverse(cov), n - 2 - len(given)
    r = -inverse[0, 1] / math.sqrt(inverse[0, 0] * inverse[1, 1])
    t = r * math.sqrt(df / (1 - r * r)) if df > 0 and abs(r) < 1 else math.nan
    return _table(rows, [(_number(r), _number(t), df)], "r double, t double, df long").withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def pearson_test(rows: DataFrame, feature: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r by feature with its t and p."""
    s = complete(rows, x, y).groupBy(*feature).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.when((F.abs("r") < 1) & (F.col("n") > 2), F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2)))
    return s.withColumn("t", t).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2))


def mahalanobis(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Squared distance of each row from the mean in the metric of the sample covariance, with its chi-square p."""
    _, means, cov = covariances(rows, columns)
    inverse = _inverse(cov)
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, means, strict=True)]
    d2 = sum(d[i] * d[j] * F.lit(float(inverse[i, j])) for i in range(len(d)) for j in range(len(d)))
    return complete(rows, *columns).select(F.col(key).alias("key"), d2.alias("distance2")).withColumn("p", chi2_sf(F.col("distance2"), F.lit(len(columns))))


def pca(rows: DataFrame, key: str, columns: list[str], components: int = 10) -> DataFrame:
    """key, component (from 1), score and share of the variance: columns filled by their mean, centred and divided by their
    deviation (divisor n, over the values that are there; 1 if none), on the eigenvectors of their cross-products. Of a
    vector's largest entries the first is positive. As many components as columns and rows allow."""
    of = [clean(c) for c in columns]
    got = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in of], *[F.stddev_pop(c) for c in of]).first()
    many = len(columns)
    means = [m if m is not None else 0.0 for m in got[1 : 1 + many]]
    spreads = [s if s is not None and s > 1e-12 else 1.0 for s in got[1 + many :]]
    z = [F.coalesce((c - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) for c, m, s in zip(of, means, spreads, strict=True)]
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    slim = rows.select(F.col(key).alias("key"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    sums = slim.agg(*[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs]).first()
    cross = np.zeros((many, many))
    for (i, j), v in zip(pairs, sums, strict=True):
        cross[i, j] = cross[j, i] = v or 0.0
    values, vectors = np.linalg.eigh(cross)
    total, out = values.sum(), []
    for place, k in enumerate(np.argsort(-values)[: min(components, many, got[0])]):
        v = vectors[:, k]
        first = int(np.flatnonzero(np.abs(v) >= np.abs(v).max() * (1 - 1e-9))[0])
        v = v * np.sign(v[first])
        score = sum(F.col(f"_z{i}") * F.lit(float(x)) for i, x in enumerate(v))
        out.append(F.struct(F.lit(place + 1).alias("component"), score.alias("score"), F.lit(float(values[k] / total) if total > 0 else None).cast("double").alias("share")))
    if not out:
        return slim.select("key", F.lit(0).alias("component"), F.lit(0.0).alias("score"), F.lit(0.0).alias("share")).where("false")
    return slim.select("key", F.explode(F.array(*out)).alias("e")).select("key", "e.*")


def sphericity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Bartlett's test that the correlation matrix is the identity, and the Kaiser-Meyer-Olkin measure."""
    n, _, cov = covariances(rows, columns)
    sd, p = np.sqrt(np.diag(cov)), len(columns)
    r = cov / np.outer(sd, sd)
    inverse = _inverse(r)
    off = ~np.eye(p, dtype=bool)
    q = inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    kmo = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (q[off] ** 2).sum())
    det = np.linalg.det(r)
    chi = -(n - 1 - (2 * p + 5) / 6) * math.log(det) if det > 0 else math.nan
    return _chi(rows, chi, p * (p - 1) // 2).withColumn("kmo", F.lit(_number(kmo)).cast("double"))


def hotelling(rows: DataFrame, columns: list[str], group: str, a, b) -> DataFrame:
    """T² of the mean vectors of groups a and b with pooled covariance, its F and p."""
    (na, ma, sa), (nb, mb, sb) = (covariances(rows.where(F.col(group) == g), columns) for g in (a, b))
    p, d = len(columns), ma - mb
    pooled = ((na - 1) * sa + (nb - 1) * sb) / (na + nb - 2)
    t2 = na * nb / (na + nb) * float(d @ _inverse(pooled) @ d)
    df2 = na + nb - p - 1
    return _f(rows, t2 * df2 / (p * (na + nb - 2)), p, df2).withColumn("t2", F.lit(_number(t2)).cast("double"))


def box_m(rows: DataFrame, columns: list[str], group: str, groups: list) -> DataFrame:
    """Box's M: equality of the groups' covariance matrices, by chi-square."""
    each = [covariances(rows.where(F.col(group) == g), columns) for g in groups]
    p, k = len(columns), len(groups)
    free = np.array([n - 1 for n, _, _ in each], dtype=float)
    pooled = sum(f * s for f, (_, _, s) in zip(free, each, strict=True)) / free.sum()
    m = free.sum() * math.log(np.linalg.det(pooled)) - sum(f * math.log(np.linalg.det(s)) for f, (_, _, s) in zip(free, each, strict=True))
    c = ((1 / free).sum() - 1 / free.sum()) * (2 * p * p + 3 * p - 1) / (6 * (p + 1) * (k - 1))
    return _chi(rows, m * (1 - c), p * (p + 1) * (k - 1) // 2)


def deming(rows: DataFrame, feature: list[str], x: str, y: str, ratio: float = 1.0) -> DataFrame:
    """Slope and intercept with errors in both variables; `ratio` is the variance of y's errors to x's."""
    s = complete(rows, x, y).groupBy(*feature).agg(F.var_samp(x).alias("a"), F.var_samp(y).alias("b"), F.covar_samp(x, y).alias("c"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    u = F.col("b") - ratio * F.col("a")
    slope = F.when(F.col("c") != 0, (u + F.sqrt(u * u + 4 * ratio * F.col("c") ** 2)) / (2 * F.col("c")))
    return s.withColumn("slope", slope).select(*feature, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def glm(rows: DataFrame, y: str, x: list[str], family: str = "logistic", rounds: int = 50, tolerance: float = 1e-12) -> DataFrame:
    """term, estimate, std_error, z, p of a logistic, poisson or gamma model (the latter two with a log link), by weighted
    least squares until no estimate moves; each round is one aggregate over the rows."""
    t = complete(rows, y, *x)
    terms = [F.lit(1.0), *[F.col(c) for c in x]]
    size = len(terms)
    mean = t.agg(F.avg(y)).first()[0]
    b = np.zeros(size)
    usable = mean is not None and mean > 0 and (family != "logistic" or mean < 1)
    b[0] = math.log(mean / (1 - mean) if family == "logistic" else mean) if usable else math.nan
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(rounds):
        eta = sum(F.lit(float(v)) * c for v, c in zip(b, terms, strict=True))
        mu = 1 / (1 + F.exp(-eta)) if family == "logistic" else F.exp(eta)
        w = {"logistic": mu * (1 - mu), "poisson": mu, "gamma": F.lit(1.0)}[family]
        rest = F.col(y) - mu if family != "gamma" else F.col(y) / mu - 1
        got = t.agg(F.count(F.lit(1)), F.sum((F.col(y) / mu - 1) ** 2), *[F.sum(terms[i] * terms[j] * w) for i, j in pairs], *[F.sum(c * rest) for c in terms]).first()
        info, score = np.empty((size, size)), np.array([math.nan if v is None else v for v in got[2 + len(pairs) :]])
        for (i, j), v in zip(pairs, got[2 : 2 + len(pairs)], strict=True):
            info[i, j] = info[j, i] = math.nan if v is None else v
        inverse = _inverse(info)
        step = inverse @ score
        b = b + step
        if not np.abs(step).max() > tolerance * (1 + np.abs(b).max()):
            break
    spread = got[1] / (got[0] - size) if family == "gamma" and got[0] > size else 1.0
    data = [(n, _number(v), _number(math.sqrt(spread * s)) if s > 0 else None) for n, v, s in zip(["intercept", *x], b, np.diag(inverse), strict=True)]
    z = F.when(F.col("std_error") > 0, F.col("estimate") / F.col("std_error"))
    return _table(rows, data, "term string, estimate double, std_error double").withColumn("z", z).withColumn("p", F.least(2 * normal_sf(F.abs("z")), F.lit(1.0)))

"""Proportional hazards. Rows are summed by distinct time, times are run backwards in ranges, and each time with deaths adds
its Efron terms; the driver solves a system as large as the number of covariates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.distributions import normal_sf
from tessella.operators.common import clean, materialized, ranges, with_before
from tessella.session import ship

_CHUNK = 1 << 20


def _efron(d: int, s0: float, d0: float) -> tuple[float, ...]:
    """Sums over the d tied deaths, f = 0, 1/d, ..., of log(s0 - f d0), 1/den, f/den, 1/den^2, f/den^2, f^2/den^2."""
    out = np.zeros(6)
    for at in range(0, d, _CHUNK):
        f = np.arange(at, min(at + _CHUNK, d)) / d
        den = s0 - f * d0
        one = 1 / den
        out += [np.log(den).sum(), one.sum(), (f * one).sum(), (one * one).sum(), (f * one * one).sum(), (f * f * one * one).sum()]
    return tuple(out)


def dummies(rows: DataFrame, x: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """Doubles, and for each categorical covariate one 0/1 column for every level but the first."""
    names = []
    for c in x:
        if c not in categorical:
            rows, names = rows.withColumn(c, clean(c)), [*names, c]
            continue
        levels = sorted(r[0] for r in rows.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().collect())  # one row a level
        for level in levels[1:]:
            rows, names = rows.withColumn(f"{c}_{level}", (F.col(c).cast("string") == level).cast("double")), [*names, f"{c}_{level}"]
    return rows, names


def cox_regression(rows: DataFrame, time: str, event: str, x: list[str], weight: str | None = None, categorical: tuple[str, ...] = (), rounds: int = 40, tolerance: float = 1e-10) -> DataFrame:
    """By covariate: coef, hr, se, z, p, ci_low, ci_high (of the hazard ratio, 95 %), and n, events, log_likelihood, aic of
    the fit. Ties by Efron's method, with weights if given.

    Rows with a missing value, or a time that is not above zero, are left out; an event is any value but zero. A
    covariate without spread, no events, or a fit that does not settle (separated groups) give no numbers.
    """
    spark = rows.sparkSession
    ship(spark)
    t, names = dummies(rows, x, list(categorical))
    w = clean(weight) if weight else F.lit(1.0)
    many = len(names)
    t = t.select((-clean(time)).alias("_back"), (clean(event).cast("int") != 0).alias("_d"), w.alias("_w"), *[F.col(c).alias(f"_z{i}") for i, c in enumerate(names)]).dropna().where("_back < 0")
    t = materialized(t)  # the rows are read once
    got = t.agg(F.count(F.lit(1)), F.count_if("_d"), *[F.avg(f"_z{i}") for i in range(many)], *[F.stddev_samp(f"_z{i}") for i in range(many)]).first()
    n, events, means, spreads = got[0], got[1], got[2 : 2 + many], got[2 + many :]
    schema = "covariate string, coef double, se double"

    def table(coef, se, ll):
        data = [(c, float(b) if math.isfinite(b) else None, float(s) if math.isfinite(s) else None) for c, b, s in zip(names, coef, se, strict=True)]
        out = spark.createDataFrame(data, schema)
        z, half = F.col("coef") / F.col("se"), F.lit(1.959963984540054) * F.col("se")
        out = out.withColumn("z", z).select("covariate", "coef", F.exp("coef").alias("hr"), "se", "z", F.least(2 * normal_sf(F.abs("z")), F.lit(1.0)).alias("p"), F.exp(F.col("coef") - half).alias("ci_low"), F.exp(F.col("coef") + half).alias("ci_high"))
        none = F.lit(None).cast("double")
        return out.withColumns({"n": F.lit(n), "events": F.lit(events), "log_likelihood": F.lit(float(ll)) if math.isfinite(ll) else none, "aic": F.lit(2.0 * many - 2 * ll) if math.isfinite(ll) else none})

    nothing = [math.nan] * many
    if not events or any(s is None or not s > 1e-12 for s in spreads):
        return table(nothing, nothing, math.nan)
    t = t.withColumns({f"_z{i}": (F.col(f"_z{i}") - m) / s for i, (m, s) in enumerate(zip(means, spreads, strict=True))})
    with_range = ranges(t, ["_back"])
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    sums = ["s0", *[f"s_{i}" for i in range(many)], *[f"s_{i}_{j}" for i, j in pairs]]
    here = Window.partitionBy("_range").orderBy("_back")

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + many + len(pairs))
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        for batch in batches:
            cols = {c: batch[c].to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names}
            risk = np.column_stack([cols[c] for c in sums])
            dead = np.column_stack([cols[f"d_{c}"] for c in sums])
            x = np.column_stack([cols[f"x_{i}"] for i in range(many)])
            for k, d in enumerate(cols["d"].astype(np.int64).tolist()):
                w = cols["w"][k] / d
                log, one, f1, two, f2, ff = _efron(d, risk[k, 0], dead[k, 0])
                s1, d1 = risk[k, 1 : 1 + many], dead[k, 1 : 1 + many]
                total[0] += cols["eta"][k] - w * log
                total[1 : 1 + many] += x[k] - w * (s1 * one - d1 * f1)
                total[1 + many :] += w * (risk[k, 1 + many :] * one - dead[k, 1 + many :] * f1 - (s1[a] * s1[b] * two - (s1[a] * d1[b] + d1[a] * s1[b]) * f2 + d1[a] * d1[b] * ff))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    def evaluate(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.col(f"_z{i}") * F.lit(float(v)) for i, v in enumerate(beta)), F.lit(0.0))
        r = F.col("_w") * F.exp(eta)
        values = [r, *[r * F.col(f"_z{i}") for i in range(many)], *[r * F.col(f"_z{i}") * F.col(f"_z{j}") for i, j in pairs]]
        dead = lambda c: F.coalesce(F.sum(F.when(F.col("_d"), c)), F.lit(0.0))
        g = t.groupBy("_back").agg(*[F.sum(v).alias(c) for c, v in zip(sums, values, strict=True)], *[dead(v).alias(f"d_{c}") for c, v in zip(sums, values, strict=True)], F.count_if("_d").alias("d"), dead(F.col("_w")).alias("w"), dead(F.col("_w") * eta).alias("eta"), *[dead(F.col("_w") * F.col(f"_z{i}")).alias(f"x_{i}") for i in range(many)])
        g = with_before(with_range(g), [], **{f"_b{c}": ("sum", F.col(c)) for c in sums})
        g = g.select("d", "w", "eta", *[f"d_{c}" for c in sums], *[f"x_{i}" for i in range(many)], *[(F.sum(c).over(here) + F.coalesce(F.col(f"_b{c}"), F.lit(0.0))).alias(c) for c in sums]).where("d > 0")
        rows = g.mapInArrow(contributions, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # one row for each number of the fit
        v = np.zeros(1 + many + len(pairs))
        for r in rows:
            v[r["pos"]] = r["v"] if r["v"] is not None else math.nan
        info = np.zeros((many, many))
        for (i, j), value in zip(pairs, v[1 + many :], strict=True):
            info[i, j] = info[j, i] = value
        return float(v[0]), v[1 : 1 + many], info

    beta, scale = np.zeros(many), np.array(spreads, float)
    ll, score, info = evaluate(beta)
    settled = False
    for _ in range(rounds):
        try:
            step = np.linalg.solve(info, score)
        except np.linalg.LinAlgError:
            break
        size = 1.0
        while size > 1e-6:
            now = evaluate(beta + size * step)
            if math.isfinite(now[0]) and now[0] >= ll - 1e-9 * abs(ll):
                break
            size /= 2
        beta, (ll, score, info) = beta + size * step, now
        if np.abs(beta).max() > 50:
            break
        if np.abs(size * step).max() < tolerance:
            settled = True
            break
    if not settled:
        return table(nothing, nothing, math.nan)
    return table(beta / scale, np.sqrt(np.diag(np.linalg.inv(info))) / scale, ll)

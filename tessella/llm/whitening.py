"""Embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers, so the fit list (each distinct vector once), its size n and its sums S are exact and no
order of summation changes them. The covariance V is never made from the rows as a whole: one Spark pass sends a block Q
of orthonormal columns to the tasks, each sums X'(XQ) over its centred rows, and the sums meet in a tree. The driver
holds the d x b block alone: Rayleigh-Ritz on Q'VQ gives values, vectors and, from the same pass, their residuals
|Vu - eu|. Passes go on with the QR of VU until the residuals of all k components are at rounding. Where the spectrum is
too flat for that the block is doubled; a block as wide as the vectors is final after one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, tune, written

#: Every x lies above its floor by this much (fixed by the definition of x).
_SHIFT = 1_000_000
#: Entries saturate here: the doubles beyond are no exact whole numbers.
_FAR = 2.0**53
_LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, col: str, scale: float, name: str = "_x") -> DataFrame:
    """Rows whose vector is neither null nor holds null, NaN or infinite entries, with floor(scale * entry) as longs."""
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_FAR)), F.lit(-_FAR))).cast("long")
    usable = F.forall(F.col(col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    return vectors.where(F.col(col).isNotNull() & usable).withColumn(name, F.transform(col, entry))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(rows: DataFrame, task: Callable[[Iterator[np.ndarray]], np.ndarray], d: int, kind: type = float) -> np.ndarray:
    """The sum over all partitions of the array that `task` makes of a partition's vectors, through about sqrt(partitions) groups."""
    width = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[int] = []

        def vectors():
            for batch in batches:
                if batch.num_rows:
                    mine[:1] = [batch["_part"][0].as_py()]
                    yield _matrix(batch["_x"], d)

        out = task(vectors())
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array([mine[0] % width], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["at", "sums"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"at": group["at"].slice(0, 1), "sums": pa.array([sum(np.frombuffer(b.as_py(), kind) for b in group["sums"]).tobytes()], pa.binary())})

    sums = rows.select(F.spark_partition_id().alias("_part"), "_x").mapInArrow(batches_of(partial), "at int, sums binary").groupBy("at").applyInArrow(add, "at int, sums binary").orderBy("at").collect()  # sqrt(partitions) rows of d x b numbers
    return sum((np.frombuffer(r["sums"], kind) for r in sums), np.zeros(1, kind))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as doubles, from the whole numbers nx - S as far as these fit."""
    y = x - _SHIFT
    if int(np.abs(y).max(initial=0)) < _LONG // (2 * n):
        return (n * y - sums.astype(np.int64)) / float(n)
    return np.array((n * y.astype(object) - sums) / n, float)


def components(fit: DataFrame, d: int, n: int, sums: np.ndarray, k: int, block: int, tolerance: float, passes: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k first unit eigenvectors (columns) and eigenvalues of the covariance of `fit`, and its trace."""
    b = min(d, block)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    history: list[float] = []
    for _ in range(passes):
        b = q.shape[1]

        def task(vectors, q=q):
            out, trace = np.zeros((d, q.shape[1])), 0.0
            for x in vectors:
                c = _centred(x, n, sums)
                out += c.T @ (c @ q)
                trace += float((c * c).sum())
            return np.append(out, trace)

        total = _total(fit, task, d) / n
        z, trace = total[:-1].reshape(d, b), float(total[-1])
        small = q.T @ z
        values, w = np.linalg.eigh((small + small.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        u, vu = q @ w, z @ w
        worst = float(np.linalg.norm(vu[:, :k] - u[:, :k] * values[:k], axis=0).max(initial=0)) / max(float(values[0]), np.finfo(float).tiny)
        if b == d or worst <= tolerance:
            return u[:, :k], values[:k], trace
        history.append(worst)
        # the residual falls by the ratio of the eigenvalues behind the block and at k; too slow a fall asks for a wider block
        pace = history[-1] / history[-2] if len(history) > 1 else values[b - 1] / max(values[min(k, b) - 1], np.finfo(float).tiny)
        left = math.log(tolerance / worst) / math.log(min(max(pace, 1e-9), 0.999999))
        if len(history) > 1 and left > 12:
            history.clear()
            more = np.random.default_rng(seed + b).standard_normal((d, min(d, 2 * b) - b))
            q = np.linalg.qr(np.concatenate([vu, more], axis=1))[0]
        else:
            q = np.linalg.qr(vu)[0]
    raise RuntimeError(f"after {passes} passes a residual of {worst:.1e} is above {tolerance:.1e}")


def whiten(vectors: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, block: int = 64, tolerance: float = 1e-13, passes: int = 500, seed: int = 1) -> DataFrame:
    """Returns for each row and component: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    x = floor(scale * entry) + 1000000. Rows whose vector is null or holds null, NaN or infinite entries are left out; so
    are vectors whose length is not the commonest one (of equally common ones the longest), and empty ones. The fit list is each
    distinct x once: n vectors with sums S. deviation is the sum over dimensions of (n*x-S)^2, exact, null beyond a long;
    whitened is x-S/n projected on the component over the root of its eigenvalue; explained its share of the trace;
    identity_error the largest absolute entry of whitened's covariance over the fit list minus the identity. There are
    as many components as k, as dimensions, and as eigenvalues above 1e-11 of the largest one: flat directions have no
    whitened form. One distinct vector, or none, gives no rows. Eigenvalues that are equal share their space in any
    rotation, the same for all rows. Repeated rows and ids, and null ids, are rows of their own; entries beyond 2^53
    saturate there. Other columns are left behind.
    """
    spark = vectors.sparkSession
    tune(spark)
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    rows = whole_numbers(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), "_v", scale).select("_id", F.transform("_x", lambda c: c + _SHIFT).alias("_x"))
    lengths = rows.where("size(_x) > 0").groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.where(F.size("_x") == d)
    fit = written(rows.select("_x").distinct())
    n = fit.count()

    def halves(vectors):
        """Sums of the upper and of the lower 20 bits: whole numbers that no count of vectors overflows."""
        out = np.zeros((2, d), np.int64)
        for x in vectors:
            y = x - _SHIFT
            out += np.stack([(y >> 20).sum(axis=0), (y & 0xFFFFF).sum(axis=0)])
        return out

    high, low = _total(fit, halves, d, np.int64).reshape(2, d)
    sums = np.array([int(h) * (1 << 20) + int(v) for h, v in zip(high, low, strict=True)], object)  # of x less 1000000
    u, values, trace = components(fit, d, n, sums, min(k, d), block, tolerance, passes, seed)
    k = int((values > max(float(values[0]), 0) * 1e-11).sum()) if trace > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    project = u[:, :k] / np.sqrt(values[:k])

    def spread(vectors):
        out, first = np.zeros((k, k)), np.zeros(k)
        for x in vectors:
            w = _centred(x, n, sums) @ project
            out += w.T @ w
            first += w.sum(axis=0)
        return np.append(out, first)

    total = _total(fit, spread, d) / n
    mean = total[k * k :]
    error = float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = values[:k] / trace

    def deviations(x: np.ndarray) -> pa.Array:
        y = x - _SHIFT
        far = int(np.abs(y).max(initial=0)) * n + int(np.abs(sums).max())
        if far < 1 << 31 and far * far * d <= _LONG or d * far * far <= _LONG:
            return pa.array(((n * y - sums.astype(np.int64)) ** 2).sum(axis=1))
        exact = ((n * y.astype(object) - sums) ** 2).sum(axis=1)
        return pa.array([int(v) if v <= _LONG else None for v in exact], pa.int64())

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["_x"], d)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            whitened = _centred(x, n, sums) @ project
            yield pa.RecordBatch.from_arrays(
                [batch["_id"].take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), deviations(x).take(at), pa.array(whitened.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                schema.names,
            )

    return rows.mapInArrow(batches_of(project_rows), schema)

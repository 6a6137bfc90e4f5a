"""Quality of labelled clusters of vectors, by sums over long coordinates; only dunn and silhouette look at pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.session import ship


def coordinates(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def variance_ratio(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz index."""
    c = coordinates(rows, key, vector, label)
    g = c.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"))
    t = g.groupBy("i").agg(F.sum(F.col("q") - F.col("s") ** 2 / F.col("n")).alias("w"), (F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return t.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.max("n").alias("n"), F.max("k").alias("k")).select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"), "k", "n")


def davies_bouldin(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    c = coordinates(rows, key, vector, label)
    m = c.groupBy("label", "i").agg(F.avg("x").alias("m"))
    spread = c.join(m, ["label", "i"]).groupBy("label", "key").agg(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)).alias("d")).groupBy("label").agg(F.avg("d").alias("s"))
    a, b = m.alias("a"), m.alias("b")
    gap = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") != F.col("b.label"))).groupBy(F.col("a.label").alias("p"), F.col("b.label").alias("q")).agg(F.sqrt(F.sum((F.col("a.m") - F.col("b.m")) ** 2)).alias("gap"))
    r = gap.join(spread.select(F.col("label").alias("p"), F.col("s").alias("sp")), "p").join(spread.select(F.col("label").alias("q"), F.col("s").alias("sq")), "q")
    return r.groupBy("p").agg(F.max((F.col("sp") + F.col("sq")) / F.col("gap")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b; what cancels in the product form is taken from the differences."""
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d = size - 2 * (a @ b.T)
    i, j = np.nonzero(~(d > 1e-4 * size))
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        d[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return np.sqrt(d)


def _block(rows: pa.Array) -> tuple[list, list, np.ndarray, pa.Array]:
    """Keys, labels, lengths and vectors of a packed block."""
    items = rows.values.slice(rows.offsets[0].as_py(), rows.offsets[-1].as_py() - rows.offsets[0].as_py()) if len(rows) else rows.values
    key, label, v = (items.field(k) for k in range(3))
    return key.to_pylist(), label.to_pylist(), pc.list_value_length(v).to_numpy(zero_copy_only=False), v


def _matrix(v: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    x = v.take(pa.array(at)).flatten().cast(pa.float64())
    return np.asarray(x.to_numpy(zero_copy_only=False), float).reshape(len(at), size)


def _compared(a: tuple, b: tuple, size: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of a's rows: which they are, all of b's, the distances (NaN if a vector has missing values or another
    length) and whether the keys differ."""
    codes = {k: i for i, k in enumerate(dict.fromkeys(a[0] + b[0]))}
    ka, kb = (np.array([codes[k] for k in x[0]], np.int64) for x in (a, b))
    shared = len(np.intersect1d(ka, kb)) > 0
    whole = {int(n): (np.nonzero(b[2] == n)[0], _matrix(b[3], np.nonzero(b[2] == n)[0], int(n))) for n in np.unique(b[2])}
    for start in range(0, len(ka), size):
        at = np.arange(start, min(start + size, len(ka)))
        d = np.full((len(at), len(kb)), np.nan)
        for n, (to, vectors) in whole.items():
            of = np.nonzero(a[2][at] == n)[0]
            if len(of):
                d[np.ix_(of, to)] = _distances(_matrix(a[3], at[of], n), vectors)
        yield at, d, ka[at, None] != kb[None, :] if shared else np.ones(d.shape, bool)


def _block_pairs(rows: DataFrame, key: str, vector: str, label: str, size: int):
    """Vectors dealt to blocks of about `size` by hash; each pair of blocks meets in one group (one or two packed rows)."""
    ship(rows.sparkSession)
    t = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    m = max(1, math.ceil(t.count() / size))
    packed = t.groupBy(F.pmod(F.xxhash64("key", "label", "v"), F.lit(m)).alias("id")).agg(F.collect_list(F.struct("key", "label", "v")).alias("rows"))
    other = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("other")
    return packed.select("id", "rows", other).select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "id", "rows").groupBy("lo", "hi"), t.schema


def _blocks(table: pa.Table) -> list[tuple]:
    return [_block(c.slice(i, 1)) for c in table["rows"].chunks for i in range(len(c))]


def _label_sums(a: tuple, b: tuple | None = None) -> Iterator[tuple]:
    """Sums of the distances from a's vectors to b's by b's label, and from b's to a's by a's, each distance worked out once;
    without b within a. block, its rows, labels of the other, places (row, label) that meet, sums, numbers of distances."""
    hot = []
    for x in (a, a if b is None else b):
        code = {k: i for i, k in enumerate(dict.fromkeys(x[1]))}
        hot.append((list(code), np.zeros((len(x[1]), len(code)))))
        hot[-1][1][np.arange(len(x[1])), [code[k] for k in x[1]]] = 1
    (names_a, hot_a), (names_b, hot_b) = hot
    back = [np.zeros((len(hot_b), len(names_a))) for _ in range(3)]  # sums, distances, pairs

    def by_label(d: np.ndarray, good: np.ndarray, apart: np.ndarray, to: np.ndarray, whole: bool) -> tuple:
        if whole:
            n = np.broadcast_to(to.sum(0), (len(d), to.shape[1]))
            return d @ to, n, n
        return d @ to, good @ to, apart @ to

    for at, d, apart in _compared(a, a if b is None else b):
        good = apart & ~np.isnan(d)
        whole = bool(good.all())
        d = d if whole else np.where(good, d, 0)
        s, n, met = by_label(d, good, apart, hot_b, whole)
        i, j = np.nonzero(met)
        yield a, at, names_b, i, j, s[i, j], np.rint(n[i, j])
        if b is not None:
            for total, more in zip(back, by_label(d.T, good.T, apart.T, hot_a[at], whole), strict=True):
                total += more
    if b is not None:
        i, j = np.nonzero(back[2])
        yield b, np.arange(len(hot_b)), names_a, i, j, back[0][i, j], np.rint(back[1][i, j])


def silhouette(rows: DataFrame, key: str, vector: str, label: str, block: int = 4096) -> DataFrame:
    """For each vector: mean distance to its own cluster (a), to the nearest other (b), and the silhouette; 0 in a cluster of
    one. All pairs are looked at, blocks of vectors with blocks; tasks return sums by vector and label."""
    pairs, schema = _block_pairs(rows, key, vector, label, block)
    out = T.StructType([schema["key"], schema["label"], T.StructField("other", schema["label"].dataType), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    ids, kinds = to_arrow_type(schema["key"].dataType), to_arrow_type(schema["label"].dataType)

    def sums(table: pa.Table) -> pa.Table:
        blocks, parts = _blocks(table), []
        own, there = table["lo"][0].as_py(), table["hi"][0].as_py()
        if own != there and len(blocks) < 2:  # the other block is empty
            return pa.Table.from_arrays([pa.array([], x) for x in (ids, kinds, kinds, pa.float64(), pa.int64())], out.names)
        taken = {id(x): (pa.array(x[0], ids), pa.array(x[1], kinds)) for x in blocks}
        for x, at, names, i, j, total, n in _label_sums(blocks[0], None if own == there else blocks[1]):
            keys, labels = (c.take(pa.array(at[i])) for c in taken[id(x)])
            parts.append(pa.Table.from_arrays([keys, labels, pa.array(names, kinds).take(pa.array(j)), pa.array(total), pa.array(n.astype(np.int64))], out.names))
        return pa.concat_tables(parts)

    m = pairs.applyInArrow(sums, out).groupBy("key", "label", "other").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("d"))
    t = m.groupBy("key", "label").agg(F.max(F.when(F.col("other") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("d"))).alias("b"))
    return t.withColumn("silhouette", F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))


def dunn(rows: DataFrame, key: str, vector: str, label: str, block: int = 4096) -> DataFrame:
    """The least distance between clusters over the largest within one; pairs as for the silhouette."""
    pairs, _ = _block_pairs(rows, key, vector, label, block)

    def extremes(table: pa.Table) -> pa.Table:
        blocks, least, most = _blocks(table), [], []
        if table["lo"][0].as_py() == table["hi"][0].as_py() or len(blocks) > 1:
            a, b = blocks[0], blocks[-1]
            code = {x: i for i, x in enumerate(dict.fromkeys(a[1] + b[1]))}
            la, lb = (np.array([code[x] for x in y[1]], np.int64) for y in (a, b))
            for at, d, apart in _compared(a, b):
                same, good = la[at, None] == lb[None, :], apart & ~np.isnan(d)
                least.append(np.min(d, where=good & ~same, initial=np.inf))
                most.append(np.max(d, where=good & same, initial=-np.inf))
        ends = [min(least, default=np.inf)], [max(most, default=-np.inf)]
        return pa.Table.from_arrays([pa.array([None if np.isinf(x[0]) else float(x[0])], pa.float64()) for x in ends], ["least", "most"])

    return pairs.applyInArrow(extremes, "least double, most double").agg(F.min("least").alias("l"), F.max("most").alias("m")).select(F.try_divide("l", "m").alias("dunn"))

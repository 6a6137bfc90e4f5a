"""Tests on distance tables (a, b, d; each pair of labels once) by permuting the labels. Permutations are a batch axis of one
pass: each is a formula of its number, so tasks agree on it without a table. A table of pairs has the square of its labels' rows, so
what travels, one small number a label, is far smaller than any of its partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean, global_row_number, materialized
from tessella.operators.gene_sets import shuffled
from tessella.session import ship

_LOT = 1 << 22


def _numbered(pairs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Pairs of the labels in `keep` (l) by number: i, j, d with i < j; the labels with theirs; how many."""
    labels = materialized(global_row_number(keep, "l", name="n").withColumn("n", F.col("n") - 1))
    t = pairs.select("a", "b", clean("d").alias("d")).where("a <> b and d is not null")
    t = t.join(labels.select(F.col("l").alias("a"), F.col("n").alias("x")), "a").join(labels.select(F.col("l").alias("b"), F.col("n").alias("y")), "b")
    return materialized(t.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "d")), labels, labels.count()


def _lots(count: int, n: int) -> list[range]:
    """Permutations 0 (none) to `count`, as many at once as keep n numbers each in bounds."""
    each = max(1, _LOT // max(n, 1))
    return [range(k, min(k + each, count + 1)) for k in range(0, count + 1, each)]


def permanova(pairs: DataFrame, groups: DataFrame, label: str, group: str, permutations: int = 999, seed: int = 0) -> DataFrame:
    """f, r2, p, n, n_groups of the groups' within and between sums of squared distances. p counts the permutations (of a stream
    of its own) whose f reaches the one observed, one added. Labels without a group, or in no pair, are left out; fewer than two groups, no
    more labels than groups, or no spread within, give no numbers."""
    spark = pairs.sparkSession
    ship(spark)
    there = pairs.select(F.col("a").alias("l")).union(pairs.select("b")).dropna().distinct()
    of = groups.select(F.col(label).alias("l"), F.col(group).cast("string").alias("g")).dropna().dropDuplicates(["l"]).join(there, "l")
    t, labels, n = _numbered(pairs, of.select("l"))
    named = labels.join(of, "l").select("n", "g").orderBy("n").collect()  # one small row a label of a square table
    names = sorted({r["g"] for r in named})
    code = np.array([names.index(r["g"]) for r in named], np.int16)
    many, sizes = len(names), np.bincount(code, minlength=max(len(names), 1)).astype(float)
    schema = "f double, r2 double, p double, n long, n_groups long"
    none = [(None, None, None, n, many)]
    if many < 2 or n <= many:
        return spark.createDataFrame(none, schema)
    within, total = np.zeros(permutations + 1), 0.0
    for lot in _lots(permutations, n):

        def sums(batches: Iterator[pa.RecordBatch], lot=lot) -> Iterator[pa.RecordBatch]:
            codes = [code[shuffled(np.arange(n), n, p, seed)] if p else code for p in lot]
            out = np.zeros(len(lot) + 1)
            for batch in batches:
                i, j, d2 = batch["i"].to_numpy(), batch["j"].to_numpy(), batch["d"].to_numpy() ** 2
                out[-1] += d2.sum()
                for k, c in enumerate(codes):
                    same = c[i] == c[j]
                    out[k] += (d2[same] / sizes[c[i[same]]]).sum()
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])

        got = t.mapInArrow(sums, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # one number a permutation
        v = np.zeros(len(lot) + 1)
        for r in got:
            v[r["k"]] = r["v"]
        within[lot.start : lot.stop], total = v[:-1], v[-1] / n
    if not within[0] > 0:
        return spark.createDataFrame(none, schema)
    with np.errstate(divide="ignore"):
        f = (total - within) / (many - 1) / (within / (n - many))
    p = (1 + int(((f[1:] >= f[0] - 1e-12) & (within[1:] > 0)).sum())) / (permutations + 1)
    return spark.createDataFrame([(float(f[0]), float((total - within[0]) / total) if total > 0 else 0.0, p, n, many)], schema)


def mantel(x: DataFrame, y: DataFrame, permutations: int = 999, seed: int = 0, alternative: str = "greater") -> DataFrame:
    """r (of the distances of both tables), p, z (mean product), n labels shared. The second table's labels are permuted, by a
    stream of their own; p of `greater`, `less` or `two-sided`. Fewer than three shared labels, or no spread, give no numbers."""
    spark = x.sparkSession
    ship(spark)
    ends = lambda t: t.select(F.col("a").alias("l")).union(t.select("b")).dropna().distinct()
    shared = materialized(ends(x).join(ends(y), "l", "left_semi"))
    s, _, n = _numbered(x, shared)
    t, _, _ = _numbered(y, shared)
    both = s.join(t.withColumnRenamed("d", "e"), ["i", "j"]).agg(F.count(F.lit(1)), F.avg("d"), F.avg("e"), F.stddev_pop("d"), F.stddev_pop("e"), F.avg(F.col("d") * F.col("e"))).first()
    schema = "r double, p double, z double, n long"
    if n < 3 or not both[3] or not both[4]:
        return spark.createDataFrame([(None, None, both[5], n)], schema)
    m, mx, my, sx, sy, z = both
    products = np.zeros(permutations + 1)
    for lot in _lots(permutations, n):

        def moved(batches: Iterator[pa.RecordBatch], lot=lot) -> Iterator[pa.RecordBatch]:
            """Each pair in each permutation: the pair of the other table that it meets."""
            to = [shuffled(np.arange(n), n, p, seed) if p else np.arange(n) for p in lot]
            for batch in batches:
                i, j = batch["i"].to_numpy(), batch["j"].to_numpy()
                for p, q in zip(lot, to, strict=True):
                    u, v = q[i], q[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p, np.int32)), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), batch["d"]], ["p", "i", "j", "d"])

        for r in s.mapInArrow(moved, "p int, i long, j long, d double").join(t.withColumnRenamed("d", "e"), ["i", "j"]).groupBy("p").agg(F.sum(F.col("d") * F.col("e")).alias("v")).collect():  # one row a permutation
            products[r["p"]] = r["v"]
    r = (products / m - mx * my) / (sx * sy)
    up, down = ((1 + int((r[1:] >= r[0] - 1e-12).sum())) / (permutations + 1), (1 + int((r[1:] <= r[0] + 1e-12).sum())) / (permutations + 1))
    p = {"greater": up, "less": down, "two-sided": min(1.0, 2 * min(up, down))}[alternative]
    return spark.createDataFrame([(float(r[0]), p, float(z), n)], schema)

"""Decision trees, forests, extra trees and gradient boosting, grown level by level on histograms.

Features are binned once: at their distinct values where these are few, else at approximate quantiles. A level of all trees
is one job on an RDD of blocks of rows, as its function alone changes and nothing is planned anew: each task walks its rows
down the trees as they stand and sums statistics by (tree, node, feature, bin); the histograms of a node are added up, and
its best split is chosen, where they meet; the driver gets one row for each split. Rows in the same
bins go the same way: but for bootstrap samples, which draw by row, they are one row with their number (for classes one by
class, for numbers with the mean target), so a level passes over the distinct ones. What a task holds is bounded by nodes x features x bins, whatever the rows; trees are grown in lots that keep it so.

A split sends value <= threshold to the left; the threshold lies midway between the values on both sides. It maximises the
sum over classes of squared counts over the weight (Gini), or the squared sum over the weight (squared error), on both
sides; of equal ones the first feature, then the smallest value. Missing values take the feature's mean over all rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.common import clean, materialized
from tessella.session import ship

_U = np.uint64
#: Poisson(1) draws by inversion: the chance of at most k.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: Numbers of histogram that a task may hold.
_CELLS = 1 << 22


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the bootstrap sample of a tree holds each row: Poisson(1) by a hash of the row's key."""
    x = rows.astype(np.uint64) ^ _U((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + 1) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(by)
    x ^= x >> _U(31)
    return np.searchsorted(_POISSON, x.astype(float) / 2.0**64).astype(float)


@dataclass
class Spec:
    """How to grow: kind of target, what a split may look at, when to stop."""

    depth: int
    min_split: float = 2
    min_leaf: float = 1
    subset: int | None = None  # features looked at in each node; None: all
    bootstrap: bool = False
    random_cuts: bool = False  # one random threshold for each feature (extra trees)
    seed: int = 0


@dataclass
class Model:
    """Trees in heap order: node i has children 2i+1 and 2i+2. feature -1 marks a leaf or a node that is not there."""

    features: list[str]
    fill: list[float]
    classes: list | None
    depth: int
    rate: float | None = None  # learning rate of a boosted model; None: trees are averaged
    base: np.ndarray = field(default_factory=lambda: np.zeros(1))
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gains: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of an n x features array: class shares, or raw scores of a boosted model, or the mean."""
        out = np.tile(self.base, (len(x), 1)) if self.rate is not None else np.zeros((len(x), self.value[0].shape[1]))
        rows = np.arange(len(x))
        for t, (f, c, v) in enumerate(zip(self.feature, self.cut, self.value, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = f[node]
                node = np.where(at >= 0, 2 * node + 1 + (x[rows, np.maximum(at, 0)] > c[node]), node)
            if self.rate is None:
                out += v[node]
            else:
                out[:, t % out.shape[1]] += self.rate * v[node, 0]
        return out if self.rate is not None else out / max(len(self.feature), 1)

    def predict(self, rows: DataFrame, key: str) -> DataFrame:
        """key, prediction and, for classes, the share of the predicted one."""
        ship(rows.sparkSession)
        sent, classes = rows.sparkSession.sparkContext.broadcast(self), self.classes
        kind = T.DoubleType() if classes is None else T.StringType()
        schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("prediction", kind), *([T.StructField("share", T.DoubleType())] if classes else [])])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for batch in batches:
                x = np.column_stack([batch[f"_x{i}"].to_numpy() for i in range(len(model.features))])
                s = model.scores(x)
                if classes is None:
                    yield pa.RecordBatch.from_arrays([batch["_key"], pa.array(s[:, 0])], schema.names)
                    continue
                if model.rate is not None:
                    s = _shares(s)
                best = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch["_key"], pa.array([classes[b] for b in best], pa.string()), pa.array(s[np.arange(len(s)), best])], schema.names)

        return _filled(rows, self.features, self.fill, F.col(key).alias("_key")).mapInArrow(apply, schema)

    def importance(self, spark) -> DataFrame:
        """feature, importance: the share of the impurity that its splits take away, of each tree and averaged (averaged
        first for a boosted model)."""
        each = np.array(self.gains).reshape(-1, len(self.features))
        if self.rate is None:
            total = each.sum(axis=1, keepdims=True)
            each = np.divide(each, total, out=np.zeros_like(each), where=total > 0)
        mean = each.mean(axis=0)
        mean = mean / mean.sum() if mean.sum() > 0 else mean
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, mean, strict=True)], "feature string, importance double")


def _shares(scores: np.ndarray) -> np.ndarray:
    """Class shares of raw scores: of two classes by the logistic function, of more by softmax."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-scores))
        return np.concatenate([1 - p, p], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _filled(rows: DataFrame, features: list[str], fill: list[float], *more) -> DataFrame:
    return rows.select(*more, *[F.coalesce(clean(f), F.lit(v)).alias(f"_x{i}") for i, (f, v) in enumerate(zip(features, fill, strict=True))])


def _cuts(rows: DataFrame, many: int, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each feature the smallest and the largest value of its bins: distinct values, or the spans between quantiles."""
    names = [f"_x{i}" for i in range(many)]
    guess = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    few = [c for c in names if guess[c] <= 1.2 * limit]
    values: dict[str, list[float]] = {}
    if few:  # 1.5 x limit values a feature at most, by the bound of the sketch
        for r in rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few])).alias("s")).select("s.*").distinct().collect():
            values.setdefault(r["c"], []).append(r["v"])
    wide = [c for c in names if len(values.get(c, [])) > limit or c not in few]
    edges = rows.agg(*[F.percentile_approx(c, [k / limit for k in range(1, limit)], 10000).alias(c) for c in wide]).first() if wide else {}
    out = []
    for c in names:
        if c in wide:
            e = np.unique(np.array(edges[c] or [0.0], float))
            out.append((np.append(-np.inf, e), np.append(e, np.inf)))
        else:
            v = np.sort(np.array(values.get(c, [0.0]), float))
            out.append((v, v))
    return out


def _best(h: np.ndarray, spec: Spec, used: int, allowed: np.ndarray, bounds: list, rng) -> tuple | None:
    """The best split of a node's histogram h[feature, bin, statistic]; statistic 0 is the weight, 1 to `used` decide."""
    total = h[0].sum(axis=0)
    if total[0] < spec.min_split:
        return None
    score = lambda s: (s[..., 1 : used + 1] ** 2).sum(axis=-1)
    whole = score(total) / total[0]
    best = None
    for f in allowed.tolist():
        there = np.flatnonzero(h[f, :, 0] > 0)
        if len(there) < 2:
            continue
        left = np.cumsum(h[f, there], axis=0)[:-1]
        right = total - left
        lo, hi = bounds[f]
        cuts = (hi[there[:-1]] + lo[there[1:]]) / 2
        if spec.random_cuts:  # the first place at or above a random value between the least and the greatest
            u = lo[there[0]] if np.isfinite(lo[there[0]]) else hi[there[0]]
            v = hi[there[-1]] if np.isfinite(hi[there[-1]]) else lo[there[-1]]
            at = min(int(np.searchsorted(cuts, u + rng.random() * (v - u))), len(cuts) - 1)
            left, right, cuts, there = left[at : at + 1], right[at : at + 1], cuts[at : at + 1], there[at : at + 2]
        fit = (left[:, 0] >= spec.min_leaf) & (right[:, 0] >= spec.min_leaf)
        if not fit.any():
            continue
        gain = np.where(fit, score(left) / left[:, 0] + score(right) / right[:, 0], -np.inf)
        k = int(np.flatnonzero(gain >= gain.max() - 1e-12 * abs(gain.max()))[0])
        if best is None or gain[k] > best[0] + 1e-12 * abs(best[0]):
            best = (float(gain[k]), f, int(there[k]), float(cuts[k]), left[k], right[k])
    if best is None or best[0] <= whole + 1e-12 * abs(whole):
        return None
    return (best[0] - whole, *best[1:])


def _blocks(table: DataFrame) -> RDD:
    """The rows of a binned table with scores as blocks of arrays: row, y, w, scores and bins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                x = np.frombuffer(b"".join(batch["bins"].to_pylist()), "<u2").reshape(n, -1)
                scores = batch["scores"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((*[batch[c].to_numpy() for c in ("row", "y", "w")], scores, x))], pa.binary())], ["block"])

    return table.select("row", "y", "w", "scores", "bins").mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def _walked(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row of bins after so many levels of a tree."""
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(levels):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
    return node


def _grow(blocks: RDD, bounds: list, trees: range, spec: Spec, used: int, stats) -> list[tuple]:
    """Grows trees at once. stats(y, scores, tree) gives the n x statistics array of a block, before draws.

    Returns for each tree: feature, bin, cut, sums of the nodes' statistics, gain by feature.
    """
    size, many, deep = 2 ** (spec.depth + 1) - 1, len(bounds), max(len(lo) for lo, _ in bounds)
    shape = None
    out = {t: (np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), {}, np.zeros(many)) for t in trees}
    frontier = {t: [0] for t in trees}
    for level in range(spec.depth):
        if not any(frontier.values()):
            break
        state = {t: (out[t][0], out[t][1], frontier[t]) for t in trees if frontier[t]}

        def histograms(some: Iterable[tuple], state=state, level=level) -> Iterator[tuple]:
            sums: dict[int, np.ndarray] = {}
            for keys, y, weight, scores, x in some:
                for t, (feature, cut, open_) in state.items():
                    slot = np.full(size, -1)
                    slot[open_] = np.arange(len(open_))
                    at = slot[_walked(x, feature, cut, level)]
                    s = stats(y, scores, t) * weight[:, None]
                    if spec.bootstrap:
                        s = s * draws(keys, t, spec.seed)[:, None]
                    keep = (at >= 0) & (s[:, 0] > 0)
                    at, s = at[keep], s[keep]
                    h = sums.setdefault(t, np.zeros((len(open_), many, deep, s.shape[1])))
                    for f in range(many):
                        place = at * deep + x[keep, f]
                        for k in range(s.shape[1]):
                            h[:, f, :, k] += np.bincount(place, s[:, k], len(open_) * deep).reshape(len(open_), deep)
            for t, h in sums.items():
                for i in np.flatnonzero(h[:, 0, :, 0].sum(axis=1) > 0):
                    yield (t, state[t][2][i]), h[i]

        def choose(met: tuple) -> tuple:
            (t, node), h = met
            rng = np.random.default_rng([spec.seed, t, node])
            allowed = np.arange(many) if spec.subset is None else np.sort(rng.choice(many, min(spec.subset, many), replace=False))
            found = _best(h, spec, used, allowed, bounds, rng)
            return t, node, *(found or (0.0, -1, 0, 0.0, h[0].sum(axis=0), h[0].sum(axis=0) * 0))

        hists = blocks.mapPartitions(histograms)
        if blocks.getNumPartitions() > 1:  # else a node has one histogram
            hists = hists.reduceByKey(np.add, min(sum(map(len, frontier.values())), blocks.context.defaultParallelism))
        frontier = {t: [] for t in trees}
        for t, node, gain, f, b, c, left, right in hists.map(choose).collect():  # a row for each open node
            feature, bins, cut, sums, gains = out[t]
            shape = left.shape
            sums.setdefault(node, left + right)
            if f < 0:
                continue
            feature[node], bins[node], cut[node] = f, b, c
            gains[f] += gain
            for child, s in ((2 * node + 1, left), (2 * node + 2, right)):
                sums[child] = s
                # a child of one class, or too light, is a leaf
                if s[0] >= spec.min_split and (used == 1 or (s[1 : used + 1] < s[0]).all()):
                    frontier[t].append(child)
    return [(f, b, c, {n: s for n, s in sums.items()}, g, shape) for f, b, c, sums, g in (out[t] for t in trees)]


def _prepared(rows: DataFrame, key: str, features: list[str], target: str, classes: list | None, limit: int, single: bool = False) -> tuple[DataFrame, list[float], list]:
    """The binned table (row, y, bins, w: how many rows it stands for, 1 if `single`), the features' means, the bins' bounds.
    Rows without a target are left out."""
    ship(rows.sparkSession)
    means = rows.agg(*[F.avg(clean(f)) for f in features]).first()
    fill = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    y = clean(target) if classes is None else F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target).cast("string")).cast("double") - 1
    slim = _filled(rows, features, fill, F.xxhash64(key).alias("row"), y.alias("y")).where("y is not null and y >= 0" if classes is not None else "y is not null")
    slim = materialized(slim)
    bounds = _cuts(slim, len(features), limit)
    edges = [hi[:-1] for _, hi in bounds]  # value <= edge: this bin; distinct values are their own edges

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.searchsorted(e, batch[f"_x{i}"].to_numpy(), "left") for i, e in enumerate(edges)]).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch["row"], batch["y"], pa.array([r.tobytes() for r in x], pa.binary())], ["row", "y", "bins"])

    binned = slim.mapInArrow(place, "row long, y double, bins binary")
    many = F.count(F.lit(1)).cast("double").alias("w")
    if single:
        binned = binned.withColumn("w", F.lit(1.0))
    elif classes is None:
        binned = binned.groupBy("bins").agg(F.avg("y").alias("y"), many).select(F.lit(0).cast("long").alias("row"), "y", "bins", "w")
    else:
        binned = binned.groupBy("bins", "y").agg(many).select(F.lit(0).cast("long").alias("row"), "y", "bins", "w")
    return materialized(binned), fill, bounds


def _classes(rows: DataFrame, target: str) -> list[str]:
    return sorted(r[0] for r in rows.select(F.col(target).cast("string")).where(F.col(target).isNotNull()).distinct().collect())  # one row a class


def _ensemble(rows: DataFrame, key: str, features: list[str], target: str, classify: bool, trees: int, spec: Spec, bins: int) -> Model:
    classes = _classes(rows, target) if classify else None
    binned, fill, bounds = _prepared(rows, key, features, target, classes, bins, spec.bootstrap)
    many = len(classes) if classify else 1
    model = Model(features, fill, classes, spec.depth)

    def stats(y, scores, t):
        out = np.ones((len(y), many + 1))
        out[:, 1:] = y[:, None] == np.arange(many) if classify else y[:, None]
        return out

    table = _blocks(binned.withColumn("scores", F.array(F.lit(0.0))))
    lot = max(1, _CELLS // (2 ** max(spec.depth - 1, 0) * len(features) * max(len(lo) for lo, _ in bounds) * (many + 1)))
    for first in range(0, trees, lot):
        for f, _, c, sums, g, shape in _grow(table, bounds, range(first, min(first + lot, trees)), spec, many, stats):
            value = np.zeros((len(f), many))
            for node, s in sums.items():
                value[node] = s[1:] / s[0] if s[0] > 0 else 0
            model.feature.append(f), model.cut.append(c), model.value.append(value), model.gains.append(g / sums[0][0] if sums else g)
    return model


def decision_tree(rows: DataFrame, key: str, features: list[str], target: str, classify: bool, depth: int = 8, min_split: float = 2, min_leaf: float = 1, bins: int = 255) -> Model:
    """One tree. classify: target's values, as text, are classes; else a number. Rows without a target are left out."""
    return _ensemble(rows, key, features, target, classify, 1, Spec(depth, min_split, min_leaf), bins)


def random_forest(rows: DataFrame, key: str, features: list[str], target: str, classify: bool, trees: int = 100, depth: int = 8, subset: int | None = None, seed: int = 0, min_split: float = 2, min_leaf: float = 1, bins: int = 255) -> Model:
    """Trees on bootstrap samples (Poisson draws by a hash of the key, so rows that share a key share draws); a node looks at
    `subset` random features: by default their square root for classes, all for numbers."""
    subset = subset or (max(1, math.isqrt(len(features))) if classify else None)
    return _ensemble(rows, key, features, target, classify, trees, Spec(depth, min_split, min_leaf, subset, True, False, seed), bins)


def extra_trees(rows: DataFrame, key: str, features: list[str], target: str, classify: bool, trees: int = 100, depth: int = 8, subset: int | None = None, seed: int = 0, min_split: float = 2, min_leaf: float = 1, bins: int = 255) -> Model:
    """Trees on all rows; of each feature a node looks at one random threshold between its least and greatest value."""
    subset = subset or (max(1, math.isqrt(len(features))) if classify else None)
    return _ensemble(rows, key, features, target, classify, trees, Spec(depth, min_split, min_leaf, subset, False, True, seed), bins)


def gradient_boosting(rows: DataFrame, key: str, features: list[str], target: str, classify: bool, trees: int = 100, rate: float = 0.1, depth: int = 3, min_split: float = 2, min_leaf: float = 1, bins: int = 255, renew: int = 8) -> Model:
    """Trees fitted one after another to the gradient of squared error, or of the logistic loss (one tree a class and round
    for more than two). A leaf adds rate times its mean gradient, for classes its Newton step. Every `renew` rounds the rows' scores are written anew."""
    classes = _classes(rows, target) if classify else None
    binned, fill, bounds = _prepared(rows, key, features, target, classes, bins)
    spec = Spec(depth, min_split, min_leaf)
    wide = 1 if not classify or len(classes) <= 2 else len(classes)
    counts = binned.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")), *[F.sum(F.when(F.col("y") == k, F.col("w")).otherwise(0.0)) for k in range(len(classes or []))]).first()
    n, mean = counts[0], counts[1]
    if not classify:
        base = np.array([mean or 0.0])
    else:
        shares = np.clip(np.array(counts[2:], float) / max(n, 1), 1e-12, 1 - 1e-12)
        base = np.array([math.log(shares[1] / shares[0])]) if wide == 1 and len(classes) == 2 else np.log(shares) if classes else np.zeros(1)
    model = Model(features, fill, classes, depth, rate, base)
    start = [float(b) for b in base]
    table, behind = binned.withColumn("scores", F.array(*[F.lit(b) for b in start])), []

    def stats(y, scores, t, pending=None):
        if not classify:
            g, h = y - scores[:, 0], np.ones(len(y))
        elif wide == 1:
            p = 1 / (1 + np.exp(-scores[:, 0]))
            g, h = y - p, p * (1 - p)
        else:
            p = _shares(scores)[:, t]
            g = (y == t) - p
            h = np.abs(g) * (1 - np.abs(g)) * wide / (wide - 1)
        return np.column_stack([np.ones(len(y)), g, h])

    def added(x: np.ndarray, scores: np.ndarray, late: list[tuple]) -> np.ndarray:
        """The scores with the trees in `late` added: (class, feature, bin, value)."""
        out = scores.copy()
        for k, f, b, v in late:
            out[:, k] += rate * v[_walked(x, f, b, depth)]
        return out

    def stepped(frame: DataFrame, late: list[tuple]) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch["bins"].to_pylist()), "<u2").reshape(batch.num_rows, len(features))
                s = added(x, batch["scores"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), late)
                yield pa.RecordBatch.from_arrays([batch["row"], batch["y"], batch["w"], batch["bins"], pa.array(list(s), pa.list_(pa.float64()))], ["row", "y", "w", "bins", "scores"])

        return frame.select("row", "y", "w", "bins", "scores").mapInArrow(step, "row long, y double, w double, bins binary, scores array<double>")

    blocks = _blocks(table).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(trees):
        if len(behind) >= renew * wide:
            table, behind = materialized(stepped(table, behind)), []
            blocks.unpersist()
            blocks = _blocks(table).persist(StorageLevel.MEMORY_AND_DISK)
        now = blocks.map(lambda block, late=tuple(behind): (*block[:3], added(block[4], block[3], late), block[4]))
        for k, (f, b, c, sums, g, shape) in enumerate(_grow(now, bounds, range(wide), spec, 1, stats)):
            value = np.zeros((len(f), 1))
            for node, s in sums.items():
                value[node] = s[1] / s[2] if s[2] > 1e-150 else 0
            model.feature.append(f), model.cut.append(c), model.value.append(value), model.gains.append(g / sums[0][0] if sums else g)
            behind.append((k, f, b, value[:, 0]))
    blocks.unpersist()
    return model


def assess(model: Model, rows: DataFrame, key: str, target: str) -> DataFrame:
    """accuracy of classes, or rmse, mae and r2, over rows with a target. The target goes along with the key, so keys may repeat."""
    truth = (clean(target) if model.classes is None else F.col(target).cast("string")).alias("_y")
    both = model.predict(rows.withColumn("_both", F.struct(F.col(key).alias("key"), truth)), "_both").select("prediction", F.col("_both._y").alias("_y")).where("_y is not null")
    if model.classes is not None:
        return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("accuracy"))
    off = F.col("prediction") - F.col("_y")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), (1 - F.sum(off * off) / F.nullif(F.var_pop("_y") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"))

"""Enrichment of gene sets along a ranking. sets: (gene, set) pairs. A running sum need only be known at its hits, so no
ranking is walked as a whole: ranks come in ranges, and hits are joined to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import average_rank, clean, global_row_number, materialized
from tessella.operators.pvalues import adjust
from tessella.session import ship


def ssgsea(cells: DataFrame, sets: DataFrame, gene: str, sample: str, value: str, set_col: str, alpha: float = 0.25, min_size: int = 1, normalize: bool = True) -> DataFrame:
    """sample, set, score: mean place of the set's genes weighted by rank^alpha less the mean place of the others, over the
    range of all scores if `normalize`. Ranks within a sample are averages of ties, cut to whole numbers; places go from the
    highest rank, ties by gene. Sets with fewer than min_size measured genes, or all of them, are left out; so are missing values."""
    t = cells.select(F.col(sample).alias("sample"), F.col(gene).alias("gene"), clean(value).alias("v")).dropna()
    t = materialized(average_rank(t, "v", "r", within=["sample"]).select("sample", "gene", F.floor("r").alias("r")))
    t = global_row_number(t.withColumn("_back", -F.col("r")), "_back", "gene", name="place", within=["sample"]).select("sample", "gene", "r", "place")
    n = t.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    member = sets.select(F.col(gene).alias("gene"), F.col(set_col).alias("set")).dropna().distinct()
    hits = t.join(member, "gene").join(n, "sample")
    w, behind = F.pow(F.col("r").cast("double"), F.lit(float(alpha))), F.col("n") - F.col("place") + 1
    s = hits.groupBy("sample", "set").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * behind).alias("ws"), F.sum(behind).alias("b")).where((F.col("k") >= min_size) & (F.col("k") < F.col("n")))
    out = (F.col("n") * (F.col("n") + 1) / 2 - F.col("b")) / (F.col("n") - F.col("k"))
    s = s.select("sample", "set", (F.col("ws") / F.col("w") - out).alias("score"))
    if not normalize:
        return s
    s = materialized(s)
    span = s.agg((F.max("score") - F.min("score")).alias("span"))
    return s.crossJoin(F.broadcast(span)).select("sample", "set", F.when(F.col("span") > 0, F.col("score") / F.col("span")).otherwise(0.0).alias("score"))  # one row


def _score(at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Enrichment scores of hits at ascending places (from 0), one for each row of weights."""
    k = weight.shape[1]
    total = weight.sum(axis=1, keepdims=True)
    weight = np.where(total > 0, weight, 1.0)
    upto = np.cumsum(weight, axis=1) / weight.sum(axis=1, keepdims=True)
    before = np.concatenate([np.zeros((len(upto), 1)), upto[:, :-1]], axis=1)
    missed = (at - np.arange(k)) / (n - k)
    high, low = np.maximum((upto - missed).max(axis=1), 0), np.minimum((before - missed).min(axis=1), 0)
    return np.where(high >= -low, high, low)


def shuffled(places: np.ndarray, n: int, number: int, seed: int) -> np.ndarray:
    """Where permutation `number` of 0..n-1 sends each place: four Feistel rounds, walked until inside. The stream is this
    function's own."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x, todo = places.astype(np.uint64), np.ones(len(places), bool)
    while todo.any():
        v = x[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            h = right + np.uint64((number * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + (r + 1) * 0xA0761D6478BD642F) & (2**64 - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (h >> np.uint64(31))) & mask
        x[todo] = left << np.uint64(half) | right
        todo = x >= n
    return x.astype(np.int64)


def gsea(ranked: DataFrame, sets: DataFrame, gene: str, value: str, set_col: str, weight: float = 1.0, permutations: int = 1000, seed: int = 0, min_size: int = 5, max_size: int = 500, method: str = "bh") -> DataFrame:
    """set, size, es, nes, p and its adjusted value. Genes are ranked from the highest value, ties by gene; es is the largest
    deviation of the running sum, hits up by |value|^weight, others down evenly. p counts permutations of the values that reach es,
    one added; nes is es over the mean of the permuted scores of its sign. Sets of min_size to max_size ranked genes, not all."""
    ship(ranked.sparkSession)
    t = ranked.select(F.col(gene).alias("gene"), clean(value).alias("v")).dropna().groupBy("gene").agg(F.max("v").alias("v"))
    t = materialized(global_row_number(t.withColumn("_back", -F.col("v")), "_back", "gene", name="at").select("gene", (F.col("at") - 1).alias("at"), F.pow(F.abs("v"), F.lit(float(weight))).alias("w")))
    n = t.count()
    member = sets.select(F.col(gene).alias("gene"), F.col(set_col).alias("set")).dropna().distinct().join(t, "gene")
    sizes = member.groupBy("set").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") >= min_size) & (F.col("size") <= max_size) & (F.col("size") < n))
    hits = materialized(member.join(sizes.select("set"), "set", "left_semi").select("set", "at", "w"))
    set_type = dict(hits.dtypes)["set"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each hit in each permutation: the place whose value it gets."""
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                at = part["at"].to_numpy()
                to = np.stack([shuffled(at, n, p + 1, seed) for p in range(permutations)])
                rows = np.tile(np.arange(len(at)), permutations)
                yield pa.RecordBatch.from_arrays([part["set"].take(pa.array(rows)), pa.array(at[rows]), pa.array(np.repeat(np.arange(1, permutations + 1, dtype=np.int32), len(at))), pa.array(to.ravel())], ["set", "at", "p", "to"])

    drawn = hits.mapInArrow(asked, f"set {set_type}, at long, p int, to long").join(t.select(F.col("at").alias("to"), "w"), "to").select("set", "at", "p", "w")

    def scored(group: pa.Table) -> pa.Table:
        """One set: at most max_size hits in every permutation."""
        p, at, w = (group[c].to_numpy() for c in ("p", "at", "w"))
        order = np.lexsort((at, p))
        k = int((p == 0).sum())
        es = _score(at[order][:k], w[order].reshape(-1, k), n)
        one, null = float(es[0]), es[1:]
        same = null[null >= 0] if one >= 0 else null[null < 0]
        reach = (null >= one).sum() if one >= 0 else (null <= one).sum()
        nes = one / abs(same.mean()) if len(same) and same.mean() != 0 else 0.0
        return pa.table({"set": group["set"].slice(0, 1), "size": [k], "es": [one], "nes": [float(nes)], "p": [float((1 + reach) / (permutations + 1))]})

    out = hits.select("set", "at", F.lit(0).alias("p"), "w").unionByName(drawn).groupBy("set").applyInArrow(scored, f"set {set_type}, size long, es double, nes double, p double")
    return adjust(materialized(out), "p", "set", method)

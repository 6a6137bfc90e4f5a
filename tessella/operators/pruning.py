"""Linkage pruning: correlated pairs from blocks of variants, then the greedy choice by blocks.

Going through the variants in order, one is kept unless a kept earlier one at most `window` places before it has r² above
the threshold with it. Moments of pairs come as matrix products of blocks of variants over chunks of samples, summed by
block. What a block decides depends on the blocks before it only by which of the `window` places before it are kept: all
blocks are walked at once as if none were, and again where the block before them ended otherwise than was taken, until
none did. As the first block is right from the start, so is each whose neighbour before it is right and agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.common import clean, global_row_number, materialized
from tessella.session import ship


def _pairs(cells: DataFrame, places: DataFrame, variant: str, sample: str, dosage: str, window: int, threshold: float, chunk: int) -> DataFrame:
    """i, j (places, i < j <= i + window) with r² above the threshold over the samples called in both, three at least."""
    block = max(window, 64)
    t = cells.select(F.col(variant).alias("variant"), F.col(sample).alias("s"), clean(dosage).alias("d")).where("d is not null").join(places, "variant")
    many = t.select("s").distinct().count()
    chunks = -(-many // chunk) or 1
    own = F.floor(F.col("at") / block).cast("long")
    # the first variants of a block are also the right-hand neighbours of the block before it
    homes = F.when((F.col("at") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    t = t.select(F.explode(homes).alias("b"), F.pmod(F.xxhash64("s"), F.lit(chunks)).cast("int").alias("c"), "at", "s", "d")
    wide = block + window
    band = np.arange(block)[:, None] + np.arange(1, window + 1)  # the places after each that its window reaches

    def moments(group: pa.Table) -> np.ndarray:
        at = group["at"].to_numpy() - group["b"][0].as_py() * block
        s = group["s"].combine_chunks().dictionary_encode()
        x = np.full((wide, len(s.dictionary)), -np.inf)
        np.maximum.at(x, (at, s.indices.to_numpy()), group["d"].to_numpy())
        m = np.isfinite(x).astype(float)
        x[m == 0] = 0
        left, mark = x[:block], m[:block]
        sums = (mark @ m.T, left @ m.T, mark @ x.T, (left * left) @ m.T, mark @ (x * x).T, left @ x.T)
        return np.stack([np.take_along_axis(v, band, 1) for v in sums])

    def links(b: int, sums: np.ndarray) -> pa.Table:
        n, sx, sy, sxx, syy, sxy = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy, cov = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2, sxy / n - sx * sy / n / n
            r2 = np.where((n >= 3) & (vx > 1e-24) & (vy > 1e-24), cov * cov / (vx * vy), 0)
        i, d = np.nonzero(r2 > threshold)
        return pa.table({"i": i + b * block, "j": i + d + 1 + b * block})

    def part(group: pa.Table) -> pa.Table:
        return pa.table({"b": [group["b"][0].as_py()], "m": pa.array([moments(group).tobytes()], pa.binary())})

    def whole(group: pa.Table) -> pa.Table:
        return links(group["b"][0].as_py(), moments(group))

    def linked(group: pa.Table) -> pa.Table:
        return links(group["b"][0].as_py(), sum(np.frombuffer(v.as_py()) for v in group["m"]).reshape(6, block, window))

    if chunks == 1:  # a block's moments are all in one group
        return t.groupBy("b").applyInArrow(whole, "i long, j long")
    return t.groupBy("b", "c").applyInArrow(part, "b long, m binary").groupBy("b").applyInArrow(linked, "i long, j long")


def ld_prune(cells: DataFrame, variant: str, sample: str, dosage: str, window: int = 50, threshold: float = 0.2, chunk: int = 4096, block: int = 4096) -> DataFrame:
    """variant, kept: every variant of the table, in the order of its column. Missing dosages count for no pair; of repeated
    cells the highest dosage counts; a missing variant is left out."""
    ship(cells.sparkSession)
    spark = cells.sparkSession
    cells = materialized(cells.select(F.col(variant).alias("variant"), F.col(sample).alias("sample"), F.col(dosage).alias("dosage")).where("variant is not null"))
    places = materialized(global_row_number(cells.select("variant").distinct(), "variant", name="n").select("variant", (F.col("n") - 1).alias("at")))
    if window < 1:
        return places.select(F.col("variant").alias(variant), F.lit(True).alias("kept"))
    size, n = max(block, window), places.count()
    wide, full = -(-window // 8), (1 << window) - 1

    def gathered(group: pa.Table) -> pa.Table:
        """Of one block: for each of its places a bit for each place before it, the next one first, that it is linked with."""
        b, j, i = group["b"][0].as_py(), group["j"].to_numpy(), group["i"].to_numpy()
        near, bits = j - i - 1, np.zeros((size, wide), np.uint8)
        np.bitwise_or.at(bits, (j - b * size, near // 8), (1 << near % 8).astype(np.uint8))
        return pa.table({"b": [b], "links": pa.array([bits.tobytes()], pa.binary())})

    def walk(links: bytes | None, before: bytes) -> tuple[bytes, list[bool]]:
        """Which of the last `window` places are kept after a block, the last one in the lowest bit, and which of its own."""
        if links is None:  # linked with nothing before: all are kept
            return full.to_bytes(wide, "little"), [True] * size
        state, kept = int.from_bytes(before, "little"), []
        for at in range(0, len(links), wide):
            keep = not int.from_bytes(links[at : at + wide], "little") & state
            state = (state << 1 | keep) & full
            kept.append(keep)
        return state.to_bytes(wide, "little"), kept

    def walked(batches):
        for batch in batches:
            rows = batch.to_pydict()
            after = [walk(x, y)[0] for x, y in zip(rows["links"], rows["before"], strict=True)]
            yield pa.RecordBatch.from_pydict({"b": pa.array(rows["b"], pa.int64()), "before": pa.array(rows["before"], pa.binary()), "after": pa.array(after, pa.binary())})

    def told(batches):
        for batch in batches:
            for b, links, before in zip(*[batch.column(c).to_pylist() for c in ("b", "links", "before")], strict=True):
                kept = walk(links, before)[1][: n - b * size]
                yield pa.RecordBatch.from_pydict({"at": pa.array(range(b * size, b * size + len(kept)), pa.int64()), "kept": pa.array(kept, pa.bool_())})

    edges = _pairs(cells, places, "variant", "sample", "dosage", window, threshold, chunk).select(F.floor(F.col("j") / size).cast("long").alias("b"), "i", "j")
    held = edges.groupBy("b").applyInArrow(gathered, "b long, links binary")
    blocks = materialized(spark.range(-(-n // size)).select(F.col("id").alias("b")).join(held, "b", "left"))
    ends = "b long, before binary, after binary"
    known = materialized(blocks.withColumn("before", F.lit(bytes(wide))).mapInArrow(walked, ends))
    while True:
        ended = known.select((F.col("b") + 1).alias("b"), F.col("after").alias("_ended"))
        stale = known.join(ended, "b").where(F.col("before") != F.col("_ended")).select("b", F.col("_ended").alias("before"))
        if stale.isEmpty():
            break
        again = blocks.join(stale, "b").mapInArrow(walked, ends)
        known = materialized(known.join(stale, "b", "left_anti").unionByName(again))
    state = blocks.join(known.select("b", "before"), "b").mapInArrow(told, "at long, kept boolean")
    return places.join(state, "at").select(F.col("variant").alias(variant), "kept")

"""Sharding by histogram sort: exact bytes below probe keys, refined until the splitters meet the tolerance, one exchange.

Rows are ordered by a 64-bit hash of their group (by default the text, so equal texts stay together). A round counts the
exact bytes and rows between the probes on all partitions, as one grouped sum; every splitter then keeps the two probes
around its target and gets new ones between them. Groups of many bytes or rows are laid out first, whole, each in the
shard with the most room, and lower that shard's target; only a group that is larger than a shard is cut into equal parts,
one for each shard. Rows of such groups are numbered by their place in the partitions that hold them, so neither ids nor
any other column need tell them apart. The other rows of a shard are parted into bins of bounded bytes by key. Row counts
of bins and groups give each row its slot without one task ever holding a shard or a hot group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import written

_PROBES = 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _below(keys: DataFrame, probes: list[int]) -> list[int]:
    """Exact bytes with a key below each probe (ascending, distinct). Returns as many numbers as probes."""
    place = _place(probes)
    rows = keys.groupBy(place.alias("p")).agg(F.sum("bytes").alias("b")).collect()  # one row more than probes at most
    sums = np.zeros(len(probes) + 1, object)
    for r in rows:
        sums[r["p"]] = int(r["b"])
    return [int(x) for x in np.cumsum(sums)[:-1]]


def _place(probes: list[int], name: str = "key"):
    """How many probes are at or below the key: a search by halves in nested conditions, log2(n) comparisons for each row."""

    def search(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(name) < F.lit(probes[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(probes))


def splitters(keys: DataFrame, targets: list[int], tolerance: float, rounds: int = 24) -> list[int]:
    """Keys below which the exact bytes are nearest to each ascending target, within `tolerance` bytes where one key's weight allows."""
    low = [(_LOW, 0)] * len(targets)
    total = int(keys.agg(F.sum("bytes")).first()[0] or 0)
    high = [(_HIGH, total)] * len(targets)
    best = [_LOW if t <= total - t else _HIGH for t in targets]
    gap = [min(t, abs(total - t)) for t in targets]
    for _ in range(rounds):
        probes = set()
        for k, t in enumerate(targets):
            (a, below), (b, above) = low[k], high[k]
            if gap[k] <= tolerance or b - a <= 1:
                continue
            share = (t - below) / max(above - below, 1)
            mid, width = a + int((b - a) * share), (b - a) // _PROBES
            near = [mid + int(width * d) for d in (-0.25, -0.05, 0, 0.05, 0.25)]
            probes |= {min(b - 1, max(a + 1, p)) for p in [*near, *range(a + width, b, max(1, width))]}
        if not probes:
            break
        probes = sorted(probes)
        for p, below in zip(probes, _below(keys, probes), strict=True):
            for k, t in enumerate(targets):
                if abs(below - t) < gap[k]:
                    gap[k], best[k] = abs(below - t), p
                if below <= t and p > low[k][0]:
                    low[k] = (p, below)
                if below >= t and p < high[k][0]:
                    high[k] = (p, below)
    return best


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text", bin_bytes: int = 2 << 20, most_bins: int = 1 << 16, group_bytes: int = 256 << 20, group_rows: int = 1 << 20) -> DataFrame:
    """Adds to each row _shard: struct(size, text_crc32, shard, slot). `size` is the UTF-8 bytes of the text (null: none) plus one.

    Shards have near-equal bytes: within `tolerance` of a shard's share, plus the weight of one group of at most that size.
    Equal texts share a shard, unless they are larger than one or, when heavy groups are laid out, no shard has room for half
    of them: then their rows are cut over all shards. Null and empty texts are one group. Rows may repeat
    in all columns, ids may be null or all the same; each row has its own slot, gapless from 0 in its shard. An empty
    table stays empty. Bins hold `bin_bytes`, or more where `most_bins` would not do. What the driver and all tasks hold are the groups beyond the tolerance, `group_bytes` or
    `group_rows`, of which there can only be as many as those bounds fit into the table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_shard", F.struct((F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    keys = written(keyed.groupBy(F.col("_shard.key").alias("key")).agg(F.sum("_shard.size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    total = int(keys.agg(F.sum("bytes")).first()[0] or 0)
    share, limit = total / shards, max(1.0, tolerance * total / shards)

    heavy = keys.where((F.col("bytes") > min(limit, group_bytes)) | (F.col("rows") > group_rows)).orderBy(F.desc("bytes"), "key").collect()
    room, homes = [share] * shards, {}
    for r in heavy:
        if r["bytes"] <= share:
            k = max(range(shards), key=lambda i: room[i])
            if room[k] >= r["bytes"] / 2:
                homes[r["key"]] = [k]
                room[k] -= r["bytes"]
                continue
        homes[r["key"]] = list(range(shards))  # larger than a shard, or than what is left of any: cut
        each = [r["rows"] * (k + 1) // shards - r["rows"] * k // shards for k in range(shards)]
        room = [x - n * r["bytes"] / r["rows"] for x, n in zip(room, each, strict=True)]  # the rows of a group weigh the same
    light = keys.join(F.broadcast(_table(docs, {k: [] for k in homes}, "")), "key", "left_anti") if homes else keys
    room = [max(0.0, x) for x in room]
    rest = int(light.agg(F.sum("bytes")).first()[0] or 0)
    scale = rest / sum(room) if sum(room) else 0
    cuts = splitters(light, [int(x) for x in np.cumsum([x * scale for x in room])[:-1]], limit / 2) if rest else [_LOW] * (shards - 1)
    cuts = [int(x) for x in np.maximum.accumulate(np.array(cuts, object))] if cuts else []

    # slots: first the heavy groups' rows, group by group, then those of the bins, which are equal parts of a shard's keys
    before, placed = [0] * shards, {}
    for r in heavy:
        where = homes[r["key"]]
        ends = [r["rows"] * (k + 1) // len(where) for k in range(len(where))]
        starts = [0, *ends[:-1]]
        placed[r["key"]] = [where, starts, [before[k] for k in where]]
        for k, a, b in zip(where, starts, ends, strict=True):
            before[k] += b - a
    each = max(bin_bytes, rest / most_bins)
    bins = [max(1, math.ceil(x * scale / each)) for x in room]
    owner = [k for k in range(shards) for _ in range(bins[k])]
    first = [int(x) for x in np.cumsum([0, *bins[:-1]])]
    edges = [_LOW, *cuts, _HIGH]
    steps = [max((edges[k + 1] - edges[k]) / bins[k], 1.0) for k in range(shards)]

    def binned(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.withColumn("_key", F.col(key)).withColumn("_at", _place(cuts, "_key") + 1)
        of = lambda values: F.element_at(F.lit(values), F.col("_at"))
        part = F.floor((F.col("_key").cast("double") - of([float(e) for e in edges[:-1]])) / of(steps))
        return rows.withColumn("_bin", (of(first) + F.least(F.greatest(part, F.lit(0)), of(bins) - 1)).cast("int")).drop("_at")

    counts = {r["_bin"]: r["c"] for r in binned(light, "key").groupBy("_bin").agg(F.sum("rows").alias("c")).collect()}  # one row for each bin
    offset = []
    for b, k in enumerate(owner):
        offset.append(before[k])
        before[k] += counts.get(b, 0)
    groups = F.broadcast(_table(docs, placed, "_where array<int>, _starts array<long>, _offsets array<long>")) if heavy else None
    cold = keyed.join(groups, F.col("_shard.key") == F.col("key"), "left_anti") if heavy else keyed
    row = F.row_number().over(Window.partitionBy("_bin").orderBy("_key", id_col)) - 1
    slots = F.broadcast(docs.sparkSession.createDataFrame(list(zip(range(len(owner)), owner, offset, strict=True)), "_bin int, _owner int, _offset long"))
    result = lambda rows, k, slot: rows.withColumn("_shard", F.struct("_shard.size", "_shard.text_crc32", k.cast("int").alias("shard"), slot.cast("long").alias("slot"))).select(*docs.columns, "_shard")
    done = result(binned(cold, "_shard.key").withColumn("_row", row).join(slots, "_bin"), F.col("_owner"), F.col("_offset") + F.col("_row"))
    if not heavy:
        return done
    # the numbers are stored with the rows, so that a repeated task cannot change them; equal texts take hardly any room
    hot = written(keyed.join(groups, F.col("_shard.key") == F.col("key")).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    here = hot.groupBy("key", part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = here.select("key", "_part", (F.sum("n").over(Window.partitionBy("key").orderBy("_part")) - F.col("n")).alias("_ahead"))  # one row for each partition
    within = F.row_number().over(Window.partitionBy("key", "_part").orderBy("_id")) - 1
    hot = hot.withColumn("_part", part).withColumn("_row", within).join(ahead, ["key", "_part"]).withColumn("_row", F.col("_row") + F.col("_ahead"))
    k = F.size(F.filter("_starts", lambda s: s <= F.col("_row")))  # the last part that starts at or before the row
    slot = F.element_at("_offsets", k) + F.col("_row") - F.element_at("_starts", k)
    return done.union(result(hot, F.element_at("_where", k), slot))


def _table(docs: DataFrame, rows: dict[int, list], columns: str = "") -> DataFrame:
    data = [(k, *v) for k, v in rows.items()]
    return docs.sparkSession.createDataFrame(data, "key long" + (f", {columns}" if columns else ""))

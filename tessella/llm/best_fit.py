"""Best-fit decreasing over a whole corpus.

What best-fit decreasing does depends on the pieces' lengths alone, and pieces of one length are alike. So the driver
packs the histogram of lengths, at most as many numbers as a sequence has tokens: bins with the same room are classes with
consecutive numbers, a segment tree over the remaining capacities finds the tightest open class in logarithmic time, and
all bins of a class take their pieces at once. The outcome is a table of runs (length, ranks -> bins and offsets) whose
size the sequence length bounds. A piece's rank among those of its length is its rank in its partition and the counts of
earlier partitions; with it every task places its own pieces, so no group, however frequent its length, meets in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, tune, written
from tessella.llm.tokens import encoder


class Rooms:
    """A segment tree over the capacities 0..top: which of them open bins have."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def mark(self, room: int, there: bool) -> None:
        at = room + self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity with an open bin that is at least `need`."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:  # up to the first ancestor with bins to the right, then down to its left-most
            if at & 1 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.any[2 * at])
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], top: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] pieces into bins of `top`: runs (length, first rank, first bin, pieces a bin, offset).

    Of a run's pieces the one of rank r goes to bin first + i // q at offset + (i % q) * length, where i = r - first rank.
    """
    rooms, classes, runs, bins = Rooms(top), {}, [], 0  # room -> list of (first bin, how many)

    def open_(room: int, first: int, many: int) -> None:
        if many and room:
            classes.setdefault(room, []).append((first, many))
            rooms.mark(room, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = rooms.tightest(size)
            if room is None:  # new bins, filled one after the other as best fit would
                room, first, many = top, bins, -(-left // (top // size))
                bins += many
            else:
                first, many = classes[room].pop()
                if not classes[room]:
                    rooms.mark(room, False)
            each = room // size
            full = min(many, left // each)
            if full:
                runs.append((size, rank, first, each, top - room))
                open_(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            first, many = first + full, many - full
            if many and left:  # the last bin of this length, not filled up with it
                runs.append((size, rank, first, left, top - room))
                open_(room - left * size, first, 1)
                first, many, left = first + 1, many - 1, 0
            open_(room, first, many)
    return np.array(runs, np.int64).reshape(-1, 5)


def best_fit_pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Returns the pieces: id_col, piece (from 0), start (ids of its document before it), length, ids_crc32, sequence_id,
    offset (its place there) and, if asked for, ids.

    A document's ids are those of its text and `end_id`. Those longer than `length` are cut into pieces of `length`, the
    last of which may be shorter; no other is cut. Pieces are packed by best-fit decreasing into sequences of at most
    `length`; sequence ids count from 0 without gaps, and a sequence's pieces lie there without gaps. Which of the pieces
    of one length goes where follows the order of the partitions. A null or empty text is `end_id` alone. Rows that share
    an id are packed one by one; a null id is kept. Of an empty table come no pieces. Other columns are left behind.
    """
    if length < 1:
        raise ValueError("length is at least 1")
    spark = docs.sparkSession
    tune(spark, 4)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    stored = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("id", id_type), *fields, *ids_field])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end, seen = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes(), np.zeros(length + 1, np.int64)
        for batch in batches:
            rows, owner, payload = [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                blob = memoryview((to_ids(text) if text else b"") + end)
                for piece, at in enumerate(range(0, len(blob), 4 * length)):
                    ids = blob[at : at + 4 * length]
                    n = len(ids) // 4
                    rows.append((int(seen[n]), piece, at // 4, n, zlib.crc32(ids)))
                    seen[n] += 1
                    owner.append(k)
                    if with_ids:
                        payload.append(np.frombuffer(ids, "<i4"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["part"].take(at), pa.array(cols[0], pa.int64()), batch["id"].take(at), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]], *([pa.array(payload, pa.list_(pa.int32()))] if with_ids else [])], stored.names)

    pieces = written(docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches_of(encode), stored))
    local = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `length` rows at most
    runs = plan(counts, length)
    # the runs of a length lie together, by rank: one number orders both
    span = max(counts.values(), default=0) + 1
    if span * (length + 1) >= 1 << 63:
        raise ValueError("too many pieces of one length")
    order = np.argsort(runs[:, 0] * span + runs[:, 1], kind="stable")
    runs = runs[order]
    keys = runs[:, 0] * span + runs[:, 1]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = local.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition and length
    schema = T.StructType([T.StructField(id_col, id_type), *fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *ids_field])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = runs[np.searchsorted(keys, size * span + rank, "right") - 1]
            i = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(run[:, 2] + i // run[:, 3]), pa.array(run[:, 4] + i % run[:, 3] * size), *([batch["ids"]] if with_ids else [])], schema.names)

    ranked = pieces.join(offsets, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"), *(["ids"] if with_ids else []))
    return ranked.mapInArrow(batches_of(place), schema)

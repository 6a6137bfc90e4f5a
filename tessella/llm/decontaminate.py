"""Benchmark decontamination by winnowing.

Of every `window - k + 1` consecutive k-grams of words the least hash is kept as a fingerprint, on both sides. Each run
of `window` words that a document shares with an item then shares a fingerprint, so the join on fingerprints misses no
run of that length. Hits are extended: the full-length runs around a joined fingerprint are looked up among the items'
runs. Items shorter than a window are one window each and are looked up at their own length.

If the benchmark's tables are within `broadcast_bytes` (counted first), they travel with the task and documents are
not shuffled at all. Beyond that, fingerprints and runs are joined by shuffle, each distinct one once per group of
documents, in `_by_shuffle`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import NOT_ALNUM, Splitter, batches_of, grams, in_sorted, inside, origin, parts, slices, text_bytes, tune, volume, wide_grams


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some run of `window` words. Ties are all kept."""
    kg = grams(hashes, k)
    ok = inside(first, window)
    reach = window - k + 1
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = kg[: len(ok)].copy()
    for d in range(1, reach):
        np.minimum(low, kg[d : d + len(ok)], out=low)
    low[~ok] = 0
    top = np.zeros(len(kg), np.uint64)
    for d in range(reach):
        np.maximum(top[d : d + len(ok)], low, out=top[d : d + len(ok)])
    at = np.flatnonzero((top == kg) & (top > 0))
    return at, kg[at]


def near(at: np.ndarray, ok: np.ndarray, reach: int) -> np.ndarray:
    """Starts of the runs that hold a fingerprint found at one of the places."""
    if not len(at):
        return at
    starts = np.unique((at[:, None] - np.arange(reach)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts < len(ok))]
    return starts[ok[starts]]


class _Words:
    def __init__(self, column):
        data, bounds = text_bytes(column)
        self.hash, _, _, self.first, self.second = Splitter(NOT_ALNUM, True, both=True)(data, bounds)

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all runs of n words, which decide hits."""
        return wide_grams(self.hash, self.second, n)


def item_runs(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, hash and row of every window of the items."""
    w = _Words(texts)
    lens = np.diff(w.first)
    out = []
    for n in np.unique(lens[lens > 0]):
        size = min(int(n), window)
        rows = (lens == n) if n < window else (lens >= window)
        if n > window and window in lens:
            continue  # done with those of exactly one window
        at = np.flatnonzero(inside(w.first, size))
        owner = np.searchsorted(w.first, at, "right") - 1
        at, owner = at[rows[owner]], owner[rows[owner]]
        out.append((np.full(len(at), size), w.runs(size)[at], owner))
        if n > window:
            break
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Table:
    """Runs of the benchmark by length, with the items that hold each."""

    def __init__(self, length: np.ndarray, run: np.ndarray, item: np.ndarray):
        self.by = {}
        for n in np.unique(length):
            r, i = run[length == n], item[length == n]
            order = np.lexsort((i, r))
            r, i = r[order], i[order]
            keys, heads = np.unique(r, return_index=True)
            self.by[int(n)] = (keys, np.append(heads, len(r)), i)

    def hits(self, w: _Words, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of all texts are in a window of an item; and pairs of text and item. starts: candidates of full length."""
        mark = np.zeros(len(w.hash) + 1, np.int32)
        pairs = []
        for n, (keys, heads, items) in self.by.items():
            at = starts if n == window else np.flatnonzero(inside(w.first, n))
            if not len(at):
                continue
            place, hit = in_sorted(keys, w.runs(n)[at])
            at, place = at[hit], place[hit]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n, -1)
            doc = np.searchsorted(w.first, at, "right") - 1
            count = heads[place + 1] - heads[place]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pairs.append(np.stack([np.repeat(doc, count), items[np.repeat(heads[place], count) + within]], 1))
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return np.cumsum(mark)[:-1] > 0, both[:, 0], both[:, 1]


def _finish(w: _Words, hit: np.ndarray, doc: np.ndarray, names: list[str | None]) -> list[pa.Array]:
    """n_words, n_hit, items, spans for each text. names: of the item of each pair."""
    before = np.concatenate([[0], np.cumsum(hit)])
    n_hit = before[w.first[1:]] - before[w.first[:-1]]
    items: list[list[str]] = [[] for _ in range(len(w.first) - 1)]
    for d, name in zip(doc.tolist(), names, strict=True):
        if name is not None:
            items[d].append(name)
    spans = [[] for _ in items]
    for d in np.flatnonzero(n_hit):
        part = hit[w.first[d] : w.first[d + 1]].astype(np.int8)
        spans[d] = np.flatnonzero(np.diff(np.concatenate([[0], part, [0]]))).reshape(-1, 2).tolist()
    return [pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = 8 << 20, group_bytes: int = 6 << 20) -> DataFrame:
    """For each document: id_col, n_words, n_hit (words inside an occurrence of an item's window), items (ids as sorted
    strings), spans (from, to in words), text and rest (a struct of all other columns).

    Words are runs of ASCII letters and digits and all non-ASCII characters; A-Z count as lower case. An item of fewer
    than `window` words is one window. Null or empty texts have no words and no hits, on both sides. An item without an
    id marks words but is not listed; items that share an id are one. Repeated documents are judged one by one. With an
    empty benchmark nothing is hit.
    """
    if not 0 < k <= window:
        raise ValueError("k must be from 1 to window")
    tune(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("none")]).alias("rest"))
    schema = T.StructType([T.StructField(id_col, base.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("text", T.StringType()), T.StructField("rest", base.schema["rest"].dataType)])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    rows, size = volume(items)
    if size + 40 * rows <= broadcast_bytes:
        return _by_broadcast(base, items, schema, window, k)
    return _by_shuffle(base, items, schema, window, k, parts(docs.sparkSession, volume(base)[1], group_bytes))


def _by_broadcast(base: DataFrame, items: DataFrame, schema: T.StructType, window: int, k: int) -> DataFrame:
    held = items.collect()  # within broadcast_bytes, as counted
    names = [r["item"] for r in held]
    texts = pa.array([r["text"] for r in held], pa.string())
    runs = _Table(*item_runs(texts, window))
    w = _Words(texts)
    prints = np.unique(winnow(w.hash, w.first, k, window)[1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = _Words(batch["text"])
            at, kept = winnow(w.hash, w.first, k, window)
            starts = near(at[in_sorted(prints, kept)[1]], inside(w.first, window), window - k + 1)
            hit, doc, item = runs.hits(w, window, starts)
            yield pa.RecordBatch.from_arrays([batch["id"], *_finish(w, hit, doc, [names[i] for i in item.tolist()]), batch["text"], batch["rest"]], schema.names)

    return base.mapInArrow(batches_of(judge), schema)


def _by_shuffle(base: DataFrame, items: DataFrame, schema: T.StructType, window: int, k: int, groups: int) -> DataFrame:
    base = origin(base, groups, "id", "text")

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _Words(b["text"])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(winnow(w.hash, w.first, k, window)[1]).view(np.int64))], ["print"])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, run, row = item_runs(b["text"], window)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(run.view(np.int64)), b["item"].take(pa.array(row))], ["words", "run", "item"])

    def doc_prints(rows: pa.Table) -> pa.Table:
        w = _Words(rows["text"])
        kept = np.unique(winnow(w.hash, w.first, k, window)[1])
        return pa.table([pa.array(kept.view(np.int64)), pa.array(np.full(len(kept), rows["origin"][0].as_py()), pa.int32())], ["print", "origin"])

    prints = items.mapInArrow(item_prints, "print long").distinct()
    windows = items.mapInArrow(item_windows, "words int, run long, item string").distinct()
    short = [r["words"] for r in windows.where(F.col("words") < window).select("words").distinct().collect()]  # fewer than `window` numbers
    joined = base.groupBy("origin").applyInArrow(doc_prints, "print long, origin int").join(prints, "print", "left_semi")

    def candidates(rows: pa.Table, found: pa.Table) -> pa.Table:
        w = _Words(rows["text"])
        at, kept = winnow(w.hash, w.first, k, window)
        starts = near(at[in_sorted(np.sort(found["print"].to_numpy().view(np.uint64)), kept)[1]], inside(w.first, window), window - k + 1)
        out = [(window, np.unique(w.runs(window)[starts]))]
        out += [(n, np.unique(w.runs(n)[inside(w.first, n)])) for n in short]
        where = rows["origin"][0].as_py() if rows.num_rows else 0
        return pa.table([pa.array(np.concatenate([np.full(len(r), n) for n, r in out]), pa.int32()), pa.array(np.concatenate([r for _, r in out]).view(np.int64)), pa.array(np.full(sum(len(r) for _, r in out), where), pa.int32())], ["words", "run", "origin"])

    runs = base.groupBy("origin").cogroup(joined.groupBy("origin")).applyInArrow(candidates, "words int, run long, origin int").join(windows, ["words", "run"]).select("origin", "words", "run", "item")

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        w = _Words(rows["text"])
        table = _Table(found["words"].to_numpy(), found["run"].to_numpy().view(np.uint64), np.arange(found.num_rows))
        hit, doc, item = table.hits(w, window, np.flatnonzero(inside(w.first, window)))
        return pa.table([rows["id"], *_finish(w, hit, doc, found["item"].take(pa.array(item)).to_pylist()), rows["text"], rows["rest"]], schema.names)

    return base.groupBy("origin").cogroup(runs.groupBy("origin")).applyInArrow(judge, schema)


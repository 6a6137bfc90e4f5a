"""Substring dedup by level-wise doubling.

Runs of a short length (`words` halved `levels` times, rounded up) are fingerprinted at every position. Only where both
ends of a run of twice the length are known to repeat is that run looked at, and so on up to `words`; a group of
documents without surviving candidates has no part in the next level. What is exchanged for a level are sorted, delta-coded fingerprints: each distinct one once per
group of documents, so a run that a third of all documents hold costs one entry per group, not one per document.

Layout: documents are dealt once to groups of bounded bytes (one exchange, reused by every level). Fingerprints go to
buckets of their leading bits; a bucket finds those in two documents or more and answers each group. Lower levels use
fingerprints with 5 bits more than the input's bytes need (a false repeat only costs work); the last level compares 128
bits, made of two unlike hashes of each word's bytes, for runs whose halves both repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Splitter, grams, in_sorted, inside, one_group, origin, pack, parts, tally, text_bytes, tune, two_groups, unpack, volume

_LEVEL = "bucket int, origin int, runs binary, again binary, twins binary, docs binary"
_ANSWER = "origin int, runs binary, twins binary, docs binary"
_SIGN = np.uint64(1 << 63)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids as unsigned numbers in the same order; rows without an id come last."""
    wide = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.where(wide.is_null().to_numpy(zero_copy_only=False), np.uint64(2**64 - 1), wide.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN)


class _Group:
    """The words of one group of documents."""

    def __init__(self, docs: pa.Table, id_col: str, text_col: str):
        data, bounds = text_bytes(docs[text_col])
        self.data, self.doc = data, _ids(docs[id_col])
        self.hash, self.start, self.end, self.first, self.second = Splitter(both=True)(data, bounds)
        self.owner = np.repeat(np.arange(len(self.doc)), np.diff(self.first))


def _twins(g: _Group, length: int, at: np.ndarray) -> np.ndarray:
    """Second hashes of the runs at these positions, from second hashes of their words' bytes."""
    return grams(g.second, length)[at]


def _candidates(g: _Group, length: int, below: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs of `length` words; if the repeating halves are given, only where both are in."""
    ok = inside(g.first, length)
    runs = grams(g.hash, length)
    if below is not None:
        half = -(-length // 2)
        hit = in_sorted(below, grams(g.hash, half) >> np.uint64(64 - bits))[1]
        ok &= hit[: len(ok)] & hit[length - half : length - half + len(ok)]
    at = np.flatnonzero(ok)
    return at, runs[at]


def _level_rows(g: _Group, where: int, at: np.ndarray, runs: np.ndarray, bits: int, bucket_bits: int, twins: np.ndarray | None) -> pa.Table:
    """One row for each bucket: the group's distinct runs, which of them are in two of its documents, and the smallest document."""
    runs = runs >> np.uint64(64 - bits)
    ids, rank = np.unique(g.doc, return_inverse=True)
    rank = rank[g.owner[at]].astype(np.uint64)
    room = max(1, (max(len(ids) - 1, 1)).bit_length())
    twin = None
    if twins is None and bits + room <= 64:
        both = tally(runs << np.uint64(room) | rank)[0]
        key, doc = both >> np.uint64(room), both & np.uint64((1 << room) - 1)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
    else:
        twins = np.zeros(len(runs), np.uint64) if twins is None else twins
        order = np.lexsort((rank, twins, runs))
        key, twin, doc = runs[order], twins[order], rank[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (twin[1:] != twin[:-1])
        keep = new.copy()
        keep[1:] |= doc[1:] != doc[:-1]
        key, twin, doc, new = key[keep], twin[keep], doc[keep], new[keep]
    heads = np.flatnonzero(new)
    again = np.diff(np.append(heads, len(key))) > 1
    key, doc = key[heads], ids[doc[heads].astype(np.int64)]
    twin = twin[heads] if twin is not None else np.zeros(len(key), np.uint64)
    cuts = np.searchsorted(key, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(bits - bucket_bits))
    edges = np.concatenate([[0], cuts, [len(key)]])
    used = np.flatnonzero(np.diff(edges))
    parted = [slice(edges[b], edges[b + 1]) for b in used.tolist()]
    last = twins is not None
    return pa.table(
        [
            pa.array(used, pa.int32()),
            pa.array([where] * len(used), pa.int32()),
            pa.array([pack(key[p], True) for p in parted], pa.binary()),
            pa.array([np.packbits(again[p]).tobytes() for p in parted], pa.binary()),
            pa.array([pack(twin[p]) if last else None for p in parted], pa.binary()),
            pa.array([pack(doc[p]) if last else None for p in parted], pa.binary()),
        ],
        ["bucket", "origin", "runs", "again", "twins", "docs"],
    )


def _repeating(last: bool):
    def answer(rows: pa.Table) -> pa.Table:
        """Of a bucket: the runs that are in two documents or more, told to each group that has them."""
        runs = [unpack(x) for x in rows["runs"].to_pylist()]
        twins = [unpack(x) for x in rows["twins"].to_pylist()] if last else []
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(r)).astype(bool) for x, r in zip(rows["again"].to_pylist(), runs, strict=True)])
        every = np.concatenate(runs)
        if last:
            two, docs = np.concatenate(twins), np.concatenate([unpack(x) for x in rows["docs"].to_pylist()])
            order = np.lexsort((docs, two, every))
            every, two, docs, again = every[order], two[order], docs[order], again[order]
            head = np.ones(len(every), bool)
            head[1:] = (every[1:] != every[:-1]) | (two[1:] != two[:-1])
        else:
            order = np.argsort(every)
            every, again = every[order], again[order]
            head = np.ones(len(every), bool)
            head[1:] = every[1:] != every[:-1]
        at = np.flatnonzero(head)
        twice = (np.diff(np.append(at, len(every))) > 1) | np.logical_or.reduceat(again, at) if len(at) else np.zeros(0, bool)
        at = at[twice]
        table, twin, least = every[at], two[at] if last else None, docs[at] if last else None
        found = []
        for k, (r, o) in enumerate(zip(runs, rows["origin"].to_pylist(), strict=True)):
            place, hit = _matched(table, twin, r, twins[k] if last else None)
            if hit.any():
                found.append((o, pack(r[hit], True), *((pack(twins[k][hit]), pack(least[place[hit]])) if last else (None, None))))
        return pa.table([pa.array([f[0] for f in found], pa.int32()), *[pa.array([f[i] for f in found], pa.binary()) for i in (1, 2, 3)]], ["origin", "runs", "twins", "docs"])

    return answer


def _matched(table: np.ndarray, twin: np.ndarray | None, runs: np.ndarray, twins: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs in an ascending table, and whether they are there; where twins are given, those agree as well."""
    place, hit = in_sorted(table, runs)
    if twins is not None and len(table):
        while True:  # runs of one hash and unlike words stand side by side
            other = np.flatnonzero(hit & (twin[place] != twins))
            if not len(other):
                break
            place[other] = np.minimum(place[other] + 1, len(table) - 1)
            hit[other] = (table[place[other]] == runs[other]) & ((twin[place[other]] == twins[other]) | (place[other] < len(table) - 1))
    return place, hit


def _told(rows: pa.Table, last: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """A group's answers from all buckets, ascending."""
    joined = lambda c: np.concatenate([unpack(x) for x in rows[c].to_pylist()]) if rows.num_rows else np.zeros(0, np.uint64)
    runs = joined("runs")
    order = np.argsort(runs, kind="stable")
    return runs[order], joined("twins")[order] if last else None, joined("docs")[order] if last else None


def substring_dedup(docs: DataFrame, words: int = 50, levels: int = 2, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 6 << 20, bucket_runs: int = 1 << 20) -> DataFrame:
    """Removes from each document the words in runs of `words` words that also start in a document with a smaller id.

    Words are runs of non-space bytes. Returns for each input row: id_col, n_words, n_removed, kept (the words left,
    joined by one space), kept_sha256, spans (from, to in words, of what went) and rest (a struct of all other columns,
    so that none can clash).

    Null text: no words, kept is empty. Rows without an id yield to all others and lose nothing to one another. Rows that
    share an id do not take words from each other. Texts shorter than `words` words stay as they are. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    _, size = volume(docs, text_col)
    groups, least = parts(spark, size, group_bytes), max(1, size // 6 // bucket_runs)
    bucket_bits = max(least - 1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    bits = min(52, max(24, max(size, 1).bit_length() + 5))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("none")]).alias("rest"))
    base = origin(base, groups, "id", "text")
    lengths = [words]
    for _ in range(levels):
        lengths.insert(0, -(-lengths[0] // 2))

    def first(rows: pa.Table) -> pa.Table:
        g = _Group(rows, "id", "text")
        at, runs = _candidates(g, lengths[0], None, 0)
        return _level_rows(g, rows["origin"][0].as_py(), at, runs, bits if levels else 64, bucket_bits, None if levels else _twins(g, words, at))

    def doubled(length: int, last: bool):
        def longer(rows: pa.Table, answers: pa.Table) -> pa.Table:
            g = _Group(rows if answers.num_rows else rows.slice(0, 0), "id", "text")  # no answer: no candidate survives here
            where = rows["origin"][0].as_py() if rows.num_rows else 0
            at, runs = _candidates(g, length, _told(answers)[0], bits)
            return _level_rows(g, where, at, runs, 64 if last else bits, bucket_bits, _twins(g, length, at) if last else None)

        return longer

    told = base.groupBy("origin").applyInArrow(one_group(first), _LEVEL).groupBy("bucket").applyInArrow(one_group(_repeating(not levels)), _ANSWER)
    for k, length in enumerate(lengths[1:], 1):
        both = base.groupBy("origin").cogroup(told.groupBy("origin"))
        told = both.applyInArrow(two_groups(doubled(length, k == levels)), _LEVEL).groupBy("bucket").applyInArrow(one_group(_repeating(k == levels)), _ANSWER)

    rest_type = base.schema["rest"].dataType
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("rest", rest_type)])

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        g = _Group(rows, "id", "text")
        gone = np.zeros(len(g.hash) + 1, np.int32)
        if answers.num_rows:
            table, twin, smallest = _told(answers, True)
            at = np.flatnonzero(inside(g.first, words))
            runs = grams(g.hash, words)[at]
            hit = in_sorted(table, runs)[1]
            at, runs = at[hit], runs[hit]
            place, hit = _matched(table, twin, runs, _twins(g, words, at))
            at, place = at[hit], place[hit]
            at = at[smallest[place] < g.doc[g.owner[at]]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + words, -1)
        cut = np.cumsum(gone)[:-1] > 0
        raw, kept, shas, spans = g.data.tobytes(), [], [], []
        for a, b in zip(g.first[:-1], g.first[1:], strict=True):
            if b == a:
                text = b""
            else:
                text = raw[g.start[a] : g.end[b - 1]]
                pieces = text.split()
                here = cut[a:b]
                text = b" ".join(pieces if not here.any() else [pieces[i] for i in np.flatnonzero(~here)])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], cut[a:b].astype(np.int8), [0]]))).reshape(-1, 2)
            kept.append(text)
            shas.append(hashlib.sha256(text).hexdigest())
            spans.append(edge.tolist())
        before = np.concatenate([[0], np.cumsum(cut)])
        return pa.table(
            [
                rows["id"],
                pa.array(np.diff(g.first), pa.int64()),
                pa.array(before[g.first[1:]] - before[g.first[:-1]], pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(shas, pa.string()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                rows["rest"],
            ],
            schema.names,
        )

    return base.groupBy("origin").cogroup(told.groupBy("origin")).applyInArrow(two_groups(apply), schema)

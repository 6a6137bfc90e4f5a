"""Alignment of two tokenizers' tokens on the bytes of the text.

Pass one encodes the texts and works on packed bitsets over the bytes of a slice of documents: one bit for each end of a
token, one set for each tokenizer. The AND of the sets are the shared cuts, and popcounts up to a cut (rank) are the
token ranges of the groups between cuts. The OR are the ends of all overlaps: a byte range without an end inside lies in
one token of each side, and two tokens overlap in one such range, so each bit of the OR is one link. Links are kept as
counted id pairs of their document. Pass two counts, over all documents, how many hold each id pair, and marks the
highest count of each id. Counts go back to the documents: frequent pairs, a bounded number, travel to the tasks; the rest
is joined by pair, where each pair has at most as many rows as its count, which the frequent pairs exceed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, in_sorted, pack, slices, tally, tune, unpack, written
from tessella.llm.tokens import _SHOWN, Encoder, _Joined, _Pieces

_CACHED = 150_000
#: Id pairs are b + a * 2^16: both vocabularies have at most 2^16 entries.
_BITS = 16
_sides: dict[tuple[str, str], Sides] = {}


class _Unequal(Exception):
    """The tokens' bytes are not those of the text."""


class Sides:
    """Both tokenizers of a worker process. `encode(text)` gives both id arrays of space + text, or None if the bytes differ."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder(a_path)
        if self.a.mode != "led":
            raise ValueError(f"{a_path} is no plain byte-level BPE")
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        shown = {chr(v): k for k, v in _SHOWN.items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes([shown[c] for c in token]) if all(c in shown for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << _BITS:
            raise ValueError("vocabularies of at most 65,536 entries")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # a model that leaves its input as it is and whose pieces hold no space behind a letter cuts before every single space
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces) and all(self.b.normalize(x) == "▁" + x.replace(" ", "▁") for x in ("a  b ", "ﬁ Å é １", "´ 　 x"))
        self.known_a, self.known_b = _Pieces(self._made_a, {}), _Pieces(self._made_b, {})

    def _checked(self, ids: np.ndarray, table: list[bytes], want: bytes) -> bytes:
        if b"".join(map(table.__getitem__, ids.tolist())) != want:
            raise _Unequal
        return ids.astype("<u4").tobytes()

    def _made_a(self, word: str) -> bytes:
        # white space at an end of the word may join with the space beside it
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Joined
        return self._checked(np.frombuffer(self.a._made(word), "<u4"), self.a_bytes, b" " + word.encode())

    def _made_b(self, word: str) -> bytes:
        return self._checked(np.array(self.b.encode(word), "<u4"), self.b_bytes, b" " + word.encode())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        for name, make in (("known_a", self._made_a), ("known_b", self._made_b)):
            known = getattr(self, name)
            if len(known) >= _CACHED:
                known.old = {}
                setattr(self, name, _Pieces(make, known))
                self.a.known, self.a.bare = _Pieces(self.a._made, {}), {}
        try:
            try:
                if not self.by_words:
                    raise _Joined
                words = text.split(" ")
                a = b"".join(map(self.known_a.__getitem__, words))
                b = b"".join(map(self.known_b.__getitem__, words))
            except _Joined:
                want = b" " + text.encode()
                a = self._checked(np.frombuffer(self.a.whole(" " + text), "<u4"), self.a_bytes, want)
                b = self._checked(np.array(self.b.encode(text), "<u4"), self.b_bytes, want)
        except _Unequal:
            return None
        return np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")


def sides(a_path: str, b_path: str) -> Sides:
    """One for each worker process and pair of files."""
    key = (a_path, b_path)
    if key not in _sides:
        _sides[key] = Sides(*key)
    return _sides[key]


class Bits:
    """A packed bitset over byte positions with rank; select of all bits at once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.ahead = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-(size + 2) // 64) * 64, np.uint8)  # places 0 to size, and one more to ask for
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits stand before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.ahead[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of two tokenizations of the same bytes: the ends of groups in bytes, in tokens of a and in tokens of b; the links' ends in bytes, tokens of a and of b.

    a_sizes, b_sizes: bytes of each token. Ends count from 1.
    """
    size = int(a_sizes.sum())
    left, right = Bits.at(np.cumsum(a_sizes), size), Bits.at(np.cumsum(b_sizes), size)
    cuts, ends = (left & right).select(), (left | right).select()
    return cuts, left.rank(cuts + 1), right.rank(cuts + 1), ends, left.rank(ends), right.rank(ends)


def _decimals(many: int) -> np.ndarray:
    """The decimals of 0..many-1, right-aligned in five bytes with zero bytes before them, and a sixth byte for the mark behind."""
    out = np.zeros((many, 6), np.uint8)
    value = np.arange(many)
    for place in range(4, -1, -1):
        out[:, place] = np.where((value > 0) | (place == 4), value % 10 + 48, 0)
        value //= 10
    return out


def written_groups(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, decimals: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups as `a1,a2|b1;` one after another, and where each group ends there."""
    a_first, b_first = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    text = np.empty((len(a) + len(b), 6), np.uint8)
    a_at = np.arange(len(a)) + np.repeat(b_first, a_ends - a_first)
    b_at = np.arange(len(b)) + np.repeat(a_ends, b_ends - b_first)
    text[a_at], text[b_at] = decimals[a], decimals[b]
    text[:, 5] = ord(",")
    text[a_at[a_ends - 1], 5], text[b_at[b_ends - 1], 5] = ord("|"), ord(";")
    used = np.cumsum(np.count_nonzero(text, axis=1))
    return text[text != 0].tobytes(), used[a_ends + b_ends - 1]


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, frequent: int = 2_000_000) -> DataFrame:
    """Returns per row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    a_path: a byte-level BPE of the tokenizers library, which encodes space + text; b_path: a sentencepiece model, which
    adds the space itself. Strings of special tokens are plain text. Texts that are null, empty, or that either
    tokenizer does not give back byte for byte have no tokens: zeros, and '' for groups and groups_sha256. A group lies
    between two byte offsets where tokens of both end; groups are written `a1,a2|b1;a3|b2,b3`. A link is a pair of token
    occurrences whose byte ranges overlap; its count is how many rows of the table hold the id pair linked; n_best counts
    the links whose count is the highest of their A id, ties included; count_sum adds the counts of all links. Rows that
    share an id or a text are documents of their own; a null id is kept. An empty table gives no rows. Other columns
    are left behind. frequent: how many id pairs, the most frequent, are sent to the tasks; the others are joined.
    """
    spark = docs.sparkSession
    tune(spark, 4)
    id_type = docs.schema[id_col].dataType
    doc = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("sha", T.StringType()), *([T.StructField("groups", T.StringType())] if with_groups else [])])
    columns = doc.names
    page = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in doc]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = sides(a_path, b_path), 0
        decimals = _decimals(1 << _BITS)
        for batch in slices(batches, "text"):
            if not batch.num_rows:
                continue
            found = [both.encode(t) if t else None for t in batch["text"].to_pylist()]
            held = [k for k, f in enumerate(found) if f is not None]
            sums = np.zeros((4, len(found)), np.int64)
            shas, groups, keys, times = [""] * len(found), [""] * len(found), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if held:
                a, b = (np.concatenate([found[k][side] for k in held]) for side in (0, 1))
                sums[:2, held] = [[len(found[k][side]) for k in held] for side in (0, 1)]
                a_size = both.a_sizes[a]
                _, a_ends, b_ends, ends, a_of, b_of = align(a, b, a_size, both.b_sizes[b])
                # texts end with a group, so all groups and links lie within one text
                last = np.cumsum(a_size)[np.cumsum(sums[0, held]) - 1]
                tops = np.searchsorted(ends, last, "right")
                stops = np.searchsorted(a_ends, np.cumsum(sums[0, held]), "right")
                sums[2, held], sums[3, held] = np.diff(stops, prepend=0), np.diff(tops, prepend=0)
                text, marks = written_groups(a, b, a_ends, b_ends, decimals)
                at = 0
                for k, stop in zip(held, marks[stops - 1].tolist(), strict=True):
                    part = text[at : stop - 1]
                    shas[k] = hashlib.sha256(part).hexdigest()
                    if with_groups:
                        groups[k] = part.decode()
                    at = stop
                pair = a[a_of].astype(np.uint64) << np.uint64(_BITS) | b[b_of].astype(np.uint64)
                owner = np.repeat(np.array(held, np.uint64), sums[3, held])
                keys, times = tally(owner << np.uint64(2 * _BITS) | pair)
            row = {"part": [batch["part"][0].as_py()], "number": [number], "pairs": [pack(keys, True)], "times": [pack(times.astype(np.uint64))], "id": [batch["id"].to_pylist()], "sha": [shas], "groups": [groups]} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), ([s.tolist()] for s in sums), strict=True))
            number += 1
            yield pa.RecordBatch.from_pydict({c: pa.array(row[c], pages_schema.field(c).type) for c in page.names})

    from pyspark.sql.pandas.types import to_arrow_schema

    pages_schema = to_arrow_schema(page)
    pages = written(docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches_of(encode), page))
    low = np.uint64((1 << 2 * _BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of the partition hold each pair; given out when a few million wait."""

        def out(waiting):
            keys, n = tally(np.concatenate(waiting))
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["pair", "n"])

        waiting, size = [], 0
        for batch in batches:
            for blob in batch["pairs"]:
                waiting.append(unpack(blob.as_py()) & low)
                size += len(waiting[-1])
                if size >= 4_000_000:
                    yield out(waiting)
                    waiting, size = [], 0
        if size:
            yield out(waiting)

    sums = pages.select("pairs").mapInArrow(batches_of(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(sums)
    a_id = F.shiftright("pair", _BITS)
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))  # at most as many rows as ids of A
    marked = counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    floor, more = 0, 0
    for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("e")).collect():  # 63 rows at most
        more += r["n"]
        if more > frequent:
            floor = (2 << r["e"]) - 1
            break
    known = marked.where(F.col("n") > floor).toArrow()  # `frequent` rows at most
    pair = known["pair"].to_numpy()
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order].astype(np.uint64), known["n"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order]))

    def looked_up(keys, times):
        table, n, best = sent.value
        at, there = in_sorted(table, keys & low)
        doc = (keys >> np.uint64(2 * _BITS)).astype(np.int64)
        if not len(table):
            at, there, n, best = np.zeros(len(keys), int), np.zeros(len(keys), bool), np.zeros(1, np.int64), np.zeros(1, bool)
        return doc, there, times * n[at] * there, times * best[at] * there

    def add(size: int, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of whole numbers by document; documents ascend."""
        upto = np.append(0, np.cumsum(values))
        bounds = np.searchsorted(doc, np.arange(size + 1))
        return upto[bounds[1:]] - upto[bounds[:-1]]

    wide = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *doc.fields])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch["id"][k].values
                n = len(ids)
                doc, _, sums, best = looked_up(unpack(batch["pairs"][k].as_py()), unpack(batch["times"][k].as_py()).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch["part"][k].as_py(), np.int32)), pa.array(np.full(n, batch["number"][k].as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(add(n, doc, best)), pa.array(add(n, doc, sums)), *[batch[c][k].values for c in columns]], wide.names)

    out = pages.mapInArrow(batches_of(answer), wide)
    if floor:

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    keys, times = unpack(batch["pairs"][k].as_py()), unpack(batch["times"][k].as_py()).astype(np.int64)
                    doc, there, _, _ = looked_up(keys, times)
                    rare = ~there
                    n = int(rare.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch["part"][k].as_py(), np.int32)), pa.array(np.full(n, batch["number"][k].as_py(), np.int64)), pa.array(doc[rare].astype(np.int32)), pa.array((keys[rare] & low).astype(np.int64)), pa.array(times[rare])], ["part", "number", "at", "pair", "times"])

        rare = pages.select("part", "number", "pairs", "times").mapInArrow(batches_of(rest), "part int, number long, at int, pair long, times long")
        found = rare.join(marked.where(F.col("n") <= floor), "pair").groupBy("part", "number", "at").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        out = out.join(found, ["part", "number", "at"], "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"), *(["groups"] if with_groups else []))

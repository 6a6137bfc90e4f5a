"""Context-tree weighting over bytes, for scoring texts.

Bytes are binary-decomposed: each of the up to 255 nodes of a byte's bit prefix has a tree of contexts, the last 0 to
`depth` bytes. A node's block probability is Krichevsky-Trofimov's; weighting mixes it half and half with the product of
its children's, up to the full depth. With the counts of the training texts fixed, the probability of a bit is the
posterior mixture of the estimates along its context path, so every (context, byte) pair has one code length.

Texts are scored as their words, A-Z lower-cased, joined by one space, and a line end that also stands before the start.

Jobs: (1) every task sends its distinct (context, byte) pairs and words with training counts, packed, to buckets, which
merge at most about 256 of them at a time, in as many rounds as that takes; the merged tables are written. (2) The trees
below three context bytes lie whole in a bucket. Their roots, summed by the last two bytes, give depth two, which goes
back to the buckets that hold such contexts; its sums by last byte, 256 * 255 rows at most, give depths one and zero.
(3) Groups of documents ask the buckets for the code lengths and counts of what they hold, and sum. A bucket that is
asked for more than `ask_keys` keys answers in several tasks. Nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import SPACES, Splitter, batches_of, in_sorted, one_group, origin, pack, parts, slices, tally, tune, two_groups, unpack, volume, written

_COUNTS = "kind string, bucket int, salt int, weight long, keys binary, counts binary"
_MERGED = f"{_COUNTS}, known long, total long"
_ROOTS = "bucket int, at long, under double, zeros double, ones double"
_MIDDLE = "at long, under double, zeros double, ones double, est double, own double"
#: Rows that one group merges, and pairs and words that a task counts before it sends them.
_FAN, _HELD = 256, 1 << 21
_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_U = np.uint64
_HALF = np.log(0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series at x + 8, less the factors between."""
    low = np.ones_like(x)
    for i in range(8):
        low *= x + i
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - np.log(low)


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def normalized(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one run of bytes, each behind `depth` line ends and with one after; and where each begins."""
    pad = b"\n" * depth
    runs = [pad + b" ".join((t or "").encode().lower().split()) + b"\n" for t in texts]
    return np.frombuffer(b"".join(runs), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)


def pairs_of(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts: context and byte in one key, the latest context byte highest; and the pairs before each text."""
    n = max(0, len(data) - depth)
    key = data[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        key |= data[depth - back : depth - back + n].astype(np.uint64) << _U(8 * (depth - back + 1))
    inner = np.ones(n, bool)
    for d in range(depth):  # those pads that end up as a predicted byte
        at = bounds[1:-1] + d - depth
        inner[at[(at >= 0) & (at < n)]] = False
    keep = np.flatnonzero(inner)
    return key[keep], np.concatenate([[0], np.cumsum(np.diff(bounds) - depth)])


def bucket_of(keys: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Pairs with the same last three context bytes (two at depth two) share a bucket."""
    top = keys >> _U(8 * (depth - min(depth, 3) + 1))
    return ((top * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)


def _nodes(keys: np.ndarray, counts: np.ndarray, depth: int, d: int, j: int):
    """Of depth d and j known bits: the nodes, each key's node, and the node's zeros and ones."""
    context = keys >> _U(8 * (depth - d + 1))
    byte = keys & _U(255)
    prefix = (_U(1) << _U(j)) | (byte >> _U(8 - j)) if j else np.ones(len(keys), np.uint64)
    node, of = np.unique(context << _U(8) | prefix, return_inverse=True)
    one = (byte >> _U(7 - j)) & _U(1) == 1
    ones = np.bincount(of, np.where(one, counts, 0), len(node))
    return node, of, np.bincount(of, counts, len(node)) - ones, ones, one


def _weighted(keys: np.ndarray, counts: np.ndarray, depth: int, least: int):
    """For each j, from `depth` up to `least`: of, zeros, ones, log probabilities by block and by weighting."""
    for j in range(8):
        levels, below = [], None
        for d in range(depth, least - 1, -1):
            node, of, zeros, ones, bit = _nodes(keys, counts, depth, d, j)
            own = _block(zeros, ones)
            if below is None:
                mixed = own
            else:
                under = np.zeros(len(node))
                np.add.at(under, of[below[0]], below[1])  # each child counts once, at its first key
                mixed = np.logaddexp(_HALF + own, _HALF + under)
            levels.append((node, of, zeros, ones, own, mixed))
            heads = np.zeros(len(node), np.int64)
            heads[of[::-1]] = np.arange(len(of))[::-1]
            below = (heads, mixed)
        yield j, bit, levels


def shorter(node: np.ndarray) -> np.ndarray:
    """The node of the context less its farthest byte."""
    return (node >> _U(16)) << _U(8) | (node & _U(255))


def mix(zeros: np.ndarray, ones: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a node above others: estimate of a one, weight of the node's own estimate, log probability by weighting."""
    own = _block(zeros, ones)
    mixed = np.logaddexp(_HALF + own, _HALF + under)
    return (ones + 0.5) / (zeros + ones + 1), np.exp(_HALF + own - mixed), mixed


def roots(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """At depth three (two if there are no more), summed by the context less its farthest byte: (that context, node), log
    probability, zeros, ones. One row for each of them."""
    out = []
    for _, _, levels in _weighted(keys, counts, depth, min(depth, 3)):
        node, _, zeros, ones, _, mixed = levels[-1]
        up = shorter(node)
        at, of = np.unique(up, return_inverse=True)
        out.append((at, *(np.bincount(of, v, len(at)) for v in (mixed, zeros, ones))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)


class Upper:
    """Depths one and zero, from the sums by last byte; and depth two of the contexts of one bucket, if given."""

    def __init__(self, at: np.ndarray, under: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        by = np.argsort(at)
        self.at, under, zeros, ones = at[by], under[by], zeros[by], ones[by]
        self.one = mix(zeros, ones, under)
        mixed = self.one[2]
        self.root, of = np.unique(self.at & _U(255), return_inverse=True)
        self.zero = mix(*(np.bincount(of, v, len(self.root)) for v in (zeros, ones, mixed)))

    def apply(self, keys: np.ndarray, depth: int, j: int, bit: np.ndarray, p: np.ndarray, two: tuple | None) -> np.ndarray:
        byte = keys & _U(255)
        prefix = (_U(1) << _U(j)) | (byte >> _U(8 - j)) if j else np.ones(len(keys), np.uint64)
        levels = [(self.at, self.one[0], self.one[1], (keys >> _U(8 * depth)) << _U(8) | prefix), (self.root, self.zero[0], self.zero[1], prefix)]
        if two is not None:
            levels.insert(0, (*two, (keys >> _U(8 * (depth - 1))) << _U(8) | prefix))
        for table, est, own, node in levels:
            at = np.searchsorted(table, node)
            p = own[at] * np.where(bit, est[at], 1 - est[at]) + (1 - own[at]) * p
        return p


def codes(keys: np.ndarray, counts: np.ndarray, depth: int, upper: Upper, two: tuple | None = None) -> np.ndarray:
    """log10 of the probability of each key's byte in its context. two: depth two's nodes, ascending, estimates of a one
    and weights, for the contexts of these keys; None at depth two."""
    total = np.zeros(len(keys))
    for j, bit, levels in _weighted(keys, counts, depth, min(depth, 3)):
        p = None
        for _, of, zeros, ones, own, mixed in levels:
            est = ((ones + 0.5) / (zeros + ones + 1))[of]
            est = np.where(bit, est, 1 - est)
            if p is None:
                p = est
            else:
                w = np.exp(_HALF + own - mixed)[of]
                p = w * est + (1 - w) * p
        total += np.log10(upper.apply(keys, depth, j, bit, p, two))
    return total


def _rows(kind: str, keys: np.ndarray, where: np.ndarray, number: int, asks: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple]:
    """Packed rows by bucket. where: each key's bucket; keys ascend within one. asks: counts of the keys and in how many
    slices they stood."""
    by = np.argsort(where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[by])) + 1
    out = []
    for part in np.split(by, cuts):
        if len(part):
            head, blob = (kind, int(where[part[0]]), number), pack(keys[part], True)
            out.append((*head, blob) if asks is None else (*head, int(asks[1][part].sum()), blob, pack(asks[0][part])))
    return out


class _Held:
    """Keys with sums, merged now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, *sums: np.ndarray) -> None:
        self.parts.append((keys, *sums))
        self.size += len(keys)
        if self.size > _HELD:
            self.merged()

    def merged(self) -> tuple[np.ndarray, ...]:
        if len(self.parts) > 1:
            keys, *sums = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[heads], *(np.add.reduceat(x[by], heads) for x in sums))]
            self.size = len(heads)
        return self.parts[0]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


class _Texts:
    """Pairs and words of a batch of texts."""

    def __init__(self, texts: list[str | None], depth: int):
        data, bounds = normalized(texts, depth)
        self.pairs, self.pair_at = pairs_of(data, bounds, depth)
        self.words, _, _, self.word_at = Splitter(SPACES)(data, bounds)


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, counts = tally(keys[learn])
    every = tally(np.append(known, tally(keys[~learn])[0]))[0]
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, known)] = counts
    return every, out


def count_tables(docs: DataFrame, depth: int, bits: int, salts: int) -> DataFrame:
    """docs: id, text, learn. The merged counts of all (context, byte) pairs and words; those not learned from count zero.
    weight: for how many keys slices of the texts would ask the bucket. A task's rows go to one of `salts` groups of their
    bucket first, these to groups of `_FAN`, until there is one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() % salts
        bucket = {"pair": lambda keys: bucket_of(keys, depth, bits), "word": lambda keys: (keys >> _U(64 - bits)).astype(np.int64)}
        held = {kind: _Held() for kind in bucket}

        def sent() -> Iterator[pa.RecordBatch]:
            for kind in bucket:
                if held[kind].parts:
                    keys, *asks = held[kind].merged()
                    yield from _table(_rows(kind, keys, bucket[kind](keys), number, asks), _COUNTS).to_batches()
                held[kind] = _Held()

        for batch in slices(batches, "text", 6 << 20):
            learn = np.array(batch["learn"].to_pylist(), bool)
            t = _Texts(batch["text"].to_pylist(), depth)
            for kind, found in (("pair", _counted(t.pairs, np.repeat(learn, np.diff(t.pair_at)))), ("word", _counted(np.append(t.words, [_END] * len(learn)), np.append(np.repeat(learn, np.diff(t.word_at)), learn)))):
                held[kind].add(*found, np.ones(len(found[0]), np.int64))
            if any(x.size > _HELD // 2 for x in held.values()):
                yield from sent()
        yield from sent()

    def merge(rows: pa.Table) -> pa.Table:
        held = _Held()
        for keys, counts in zip(rows["keys"], rows["counts"], strict=True):
            held.add(unpack(keys.as_py()), unpack(counts.as_py()).astype(np.int64))
        keys, counts = held.merged()
        kind, word = rows["kind"][0].as_py(), rows["kind"][0].as_py() == "word"
        return _table([(kind, rows["bucket"][0].as_py(), rows["salt"][0].as_py(), pc.sum(rows["weight"]).as_py(), pack(keys, True), pack(counts), int((counts > 0).sum()) if word else 0, int(counts.sum()) if word else 0)], _MERGED)

    out = docs.mapInArrow(batches_of(count), _COUNTS)
    while True:
        out = out.groupBy("kind", "bucket", "salt").applyInArrow(one_group(merge), _MERGED)
        if salts == 1:
            return out.drop("salt")
        salts = -(-salts // _FAN)
        out = out.withColumn("salt", F.expr(f"salt div {_FAN}").cast("int"))


def middle(rows: DataFrame) -> DataFrame:
    """Depth two, from the sums of the roots below it: adds estimate and weight; `under` becomes the mixture's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zeros, ones = (b[c].to_numpy(zero_copy_only=False) for c in ("zeros", "ones"))
            est, own, mixed = mix(zeros, ones, b["under"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b["at"], pa.array(mixed), b["zeros"], b["ones"], pa.array(est), pa.array(own)], ["at", "under", "zeros", "ones", "est", "own"])

    return rows.mapInArrow(run, _MIDDLE)


def score_texts(docs: DataFrame, learn, depth: int = 5, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 6 << 20, ask_keys: int = 1 << 22) -> DataFrame:
    """Learns from the rows where the condition `learn` holds and scores all: id_col, learned, n_tokens (words and one end),
    n_known (tokens seen in training), train_tokens, base_score (log10 of smoothed unigrams), score (log10 probability by
    context-tree weighting of the normalized bytes), n_bytes (those bytes) and bits_per_byte.

    A null or empty text is its end alone. Where `learn` is null the row is not learned from. Rows may repeat and are
    scored one by one. With nothing to learn from every bit has probability 1/2 and no token is known. Other columns are
    not returned. `depth` is from 2 to 5: five bytes of context, the byte and a document number share 64 bits.
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth must be from 2 to 5")
    spark = docs.sparkSession
    tune(spark, 6)
    _, size = volume(docs, text_col)
    groups = parts(spark, size, group_bytes)
    bits = max(1, size // 6 >> 20, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    tables = written(count_tables(base, depth, bits, max(1, -(-size // ((6 << 20) * _FAN)))))
    sums = tables.agg(F.sum("total"), F.sum("known"), F.max("weight")).first()
    total, vocabulary, most = (int(x or 0) for x in sums)

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, keys, counts in zip(*(batch[c].to_pylist() for c in ("bucket", "keys", "counts")), strict=True):
                at, under, zeros, ones = roots(unpack(keys), unpack(counts).astype(float), depth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), bucket, np.int32)), pa.array(at.astype(np.int64)), pa.array(under), pa.array(zeros), pa.array(ones)], ["bucket", "at", "under", "zeros", "ones"])

    every = [F.sum(c).alias(c) for c in ("under", "zeros", "ones")]
    below = tables.where("kind = 'pair'").select("bucket", "keys", "counts").mapInArrow(low, _ROOTS)
    twos = None
    if depth > 2:
        below = written(below)
        two = written(middle(below.groupBy("at").agg(*every)))
        twos = below.select("bucket", "at").join(two.select("at", "est", "own"), "at").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("at", "est", "own"))).alias("two"))  # as many as the bucket has contexts of two bytes, times 255
        below = two.withColumn("at", F.expr("(shiftright(at, 16) * 256) | (at & 255)"))
    held = below.groupBy("at").agg(*every).collect()  # 256 * 255 rows at most
    upper = Upper(np.array([r["at"] for r in held], np.uint64), *(np.array([r[c] for r in held], float) for c in ("under", "zeros", "ones")))

    base = origin(base, groups, "id", "text")

    def ask(rows: pa.Table) -> pa.Table:
        t = _Texts(rows["text"].to_pylist(), depth)
        where = rows["origin"][0].as_py()
        pairs, words = tally(t.pairs)[0], tally(np.append(t.words, _END))[0]
        return _table(_rows("pair", pairs, bucket_of(pairs, depth, bits), where) + _rows("word", words, (words >> _U(64 - bits)).astype(np.int64), where), "kind string, bucket int, origin int, keys binary")

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        out, row, two = [], None, None
        for i in range(known.num_rows):
            if known["two"][i].is_valid:
                values = known["two"].slice(i, 1).combine_chunks().flatten()
                two = (values.field("at").to_numpy().astype(_U), values.field("est").to_numpy(), values.field("own").to_numpy())
            else:
                row = i
        if row is not None and asked.num_rows:
            kind, bucket = known["kind_t"][row].as_py(), known["bucket_t"][row].as_py()
            keys, values = unpack(known["keys"][row].as_py()), unpack(known["counts"][row].as_py())
            if kind == "pair":
                values = codes(keys, values.astype(float), depth, upper, two).astype(np.float32).view(np.uint32)
            for where, blob in zip(asked["origin"], asked["keys"], strict=True):
                out.append((where.as_py(), kind, bucket, pack(values[in_sorted(keys, unpack(blob.as_py()))[0]])))
        return _table(out, "origin_t int, kind string, bucket int, values binary")

    asked = base.groupBy("origin").applyInArrow(one_group(ask), "kind string, bucket int, origin int, keys binary")
    known = tables.select(F.col("kind").alias("kind_t"), F.col("bucket").alias("bucket_t"), "keys", "counts", "weight")
    known = known.withColumn("two", F.lit(None).cast("array<struct<at: bigint, est: double, own: double>>"))
    if twos is not None:
        heavy = tables.where("kind = 'pair'").select("bucket", "weight")
        known = known.unionByName(twos.join(heavy, "bucket").select(F.lit("pair").alias("kind_t"), F.col("bucket").alias("bucket_t"), "weight", "two"), allowMissingColumns=True)
    cuts = F.ceil(F.col("weight") / ask_keys).cast("int")
    known = known.withColumn("salt_t", F.explode(F.sequence(F.lit(0), F.greatest(cuts, F.lit(1)) - 1))).drop("weight")
    if most > ask_keys:
        split = tables.where(F.col("weight") > ask_keys).select("kind", "bucket", cuts.alias("cuts"))
        asked = asked.join(split, ["kind", "bucket"], "left").withColumn("salt", F.pmod(F.hash("origin"), F.coalesce("cuts", F.lit(1)))).drop("cuts")
    else:
        asked = asked.withColumn("salt", F.lit(0))
    told = asked.groupBy("kind", "bucket", "salt").cogroup(known.groupBy("kind_t", "bucket_t", "salt_t")).applyInArrow(two_groups(answer), "origin_t int, kind string, bucket int, values binary")
    schema = T.StructType([T.StructField(id_col, base.schema["id"].dataType), T.StructField("learned", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")], T.StructField("n_bytes", T.LongType()), T.StructField("bits_per_byte", T.DoubleType())])

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([], pa.schema([(f.name, pa.from_numpy_dtype(np.int64)) for f in schema]))
        t = _Texts(rows["text"].to_pylist(), depth)
        blobs = {(k, b): v for k, b, v in zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["values"].to_pylist(), strict=True)}

        def values(kind: str, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
            by = np.argsort(where, kind="stable")
            out = np.zeros(len(keys), np.uint64)
            for part in np.split(by, np.flatnonzero(np.diff(where[by])) + 1):
                if len(part):
                    out[part] = unpack(blobs[kind, int(where[part[0]])])
            return out

        n = rows.num_rows
        words = tally(np.append(t.words, _END))[0]
        counts = values("word", words, (words >> _U(64 - bits)).astype(np.int64)).astype(np.int64)
        logs = np.log10((counts + 0.1) / (total + 0.1 * (vocabulary + 1)))
        at = np.searchsorted(words, t.words)
        owner = np.repeat(np.arange(n), np.diff(t.word_at))
        end = np.searchsorted(words, _END)
        unigrams = np.bincount(owner, logs[at], n) + logs[end]
        known = np.bincount(owner, counts[at] > 0, n).astype(np.int64) + int(counts[end] > 0)
        pairs = tally(t.pairs)[0]
        prices = values("pair", pairs, bucket_of(pairs, depth, bits)).astype(np.uint32).view(np.float32).astype(float)
        tree = np.zeros(n)
        for a in range(0, n, 1 << 16):  # document number and pair in one sortable key
            b = min(n, a + (1 << 16))
            part = t.pairs[t.pair_at[a] : t.pair_at[b]] << _U(16)
            part |= np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(t.pair_at[a : b + 1]))
            part.sort()
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            times = np.diff(np.append(heads, len(part)))
            part = part[heads]
            tree[a:b] += np.bincount((part & _U(0xFFFF)).astype(np.int64), prices[np.searchsorted(pairs, part >> _U(16))] * times, b - a)
        size = np.diff(t.pair_at)
        return pa.table([rows["id"], rows["learn"], pa.array(np.diff(t.word_at) + 1, pa.int64()), pa.array(known), pa.array(np.full(n, total)), pa.array(unigrams), pa.array(tree), pa.array(size, pa.int64()), pa.array(-tree * np.log2(10) / size)], schema.names)

    return base.groupBy("origin").cogroup(told.groupBy("origin_t")).applyInArrow(two_groups(score), schema)

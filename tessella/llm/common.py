"""Shared helpers: word hashing on Arrow buffers, compact arrays for shuffles, scratch tables.

Everything here works on one Arrow batch or one bounded group at a time, inside a Spark task.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import ship

#: Bytes that part words: space and \t \n \v \f \r.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes that part words of the benchmark's kind: all ASCII but digits and letters.
NOT_ALNUM = bytes(b for b in range(0x80) if not chr(b).isalnum())

_SEGMENT = 1 << 18
_U = np.uint64
#: Keys of the first word hash: one for each length up to eight bytes, others for the steps of longer words. The highest
#: byte of the first eight is their length, so that words of up to seven bytes have hashes of their own.
_KEYS = np.random.default_rng(20240501).integers(1, 2**63, 16, dtype=np.uint64) | _U(1)
_KEYS[:8] = (_KEYS[:8] & _U(2**56 - 1)) | (np.arange(8, dtype=np.uint64) << _U(56))
#: Keys of the second.
_OTHERS = np.random.default_rng(20261128).integers(1, 2**63, 16, dtype=np.uint64) | _U(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words beyond this many bytes are hashed one by one.
_LONG = 64


def tune(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds the Arrow batches that Python workers get, for the session: long texts would else make batches of gigabytes."""
    ship(spark)
    conf = spark.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def volume(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column; two numbers, counted over all rows."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def parts(spark: SparkSession, amount: int, each: int) -> int:
    """How many buckets hold `amount` at `each` per bucket; at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each), 1)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives freed memory back to the machine: a worker process lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def one_group(f):
    """A grouped-map function that leaves no freed memory behind."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return f(rows)
        finally:
            trim()

    return run


def two_groups(f):
    """The same for cogroups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            trim()

    return run


def batches_of(f):
    """The same for functions over record batches."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def slices(batches, column: str, limit: int = 1 << 20):
    """The same record batches in slices of about `limit` bytes of a text column, or of one longer row."""
    for batch in batches:
        _, bounds = text_bytes(batch[column])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def _spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers in which every input bit reaches every output bit."""
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _stir(x: np.ndarray) -> np.ndarray:
    """Another such map, of other shifts and factors."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, both: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of byte strings, and with `both` a second one of the same bytes, by another function.

    Two chains of 64 bits with keys and steps of their own walk over a string, eight bytes a step. Of up to seven bytes the
    first hash is the first chain, in which such strings never collide. Of eight bytes or more it is both chains in one
    number: one chain can be run backwards to make it collide, but the sum of the two cannot, and strings with both hashes
    alike would have to collide in both chains, 128 bits. Beyond `_LONG` bytes both come from one BLAKE2b digest.
    data: with eight bytes more behind the last string."""
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    sizes = ends - starts
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return (none, none) if both else none
    short = np.minimum(sizes, 8)
    head = words[starts] & _MASKS[short]
    h = _spread(head ^ _KEYS[short])
    wide = np.flatnonzero(sizes >= 8)  # those that take both chains
    t = _stir(head * _OTHERS[9] + _OTHERS[short]) if both else None
    chain = t[wide] if both else _stir(head[wide] * _OTHERS[9] + _OTHERS[8])
    size = sizes[wide]
    at, more = 8, np.flatnonzero((size > 8) & (size <= _LONG))
    while len(more):
        place = wide[more]
        part = words[starts[place] + at] & _MASKS[np.minimum(size[more] - at, 8)]
        n = size[more].astype(np.uint64)
        h[place] = _spread((h[place] * _KEYS[9] + _KEYS[10]) ^ _spread((part + _KEYS[11]) ^ n * _KEYS[12]))
        chain[more] = _stir((chain[more] ^ _OTHERS[10]) * _OTHERS[11] + _stir((part ^ _OTHERS[12]) * _OTHERS[13] + n))
        at += 8
        more = more[size[more] > at]
    h[wide] ^= _stir(chain ^ _OTHERS[14])
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[wide[i]] : ends[wide[i]]].tobytes(), digest_size=16).digest()
        h[wide[i]], chain[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    if not both:
        return h
    t[wide] = chain
    return h, t


class Splitter:
    """Finds and hashes the words of many texts at once, on their UTF-8 bytes."""

    def __init__(self, seps: bytes = SPACES, lower: bool = False, heads: tuple[int, ...] = (), both: bool = False):
        self.heads, self.both = heads, both
        self.sep = np.zeros(256, bool)
        self.sep[list(seps)] = True
        self.lowered = np.arange(256, dtype=np.uint8)
        self.lowered[65:91] += 32
        self.lower = lower

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple:
        """Hashes, starts and ends of all words, and the number of words before each text.

        data: bytes; bounds: where each text starts, and the last ends. A word ends at a separator or with its text.
        With `heads`, a fifth value has for each of these lengths the hash of that many first bytes (0: shorter words).
        With `both`, the last value has the second hashes.
        """
        at, end, out = int(bounds[0]), int(bounds[-1]), []
        inner = np.unique(bounds[1:-1])
        while at < end:
            step = _SEGMENT
            while True:  # to the end, or behind the last separator
                stop = min(at + step, end)
                if stop == end:
                    break
                gaps = np.flatnonzero(self.sep[data[at:stop]])
                if len(gaps):
                    stop = at + int(gaps[-1]) + 1
                    break
                step *= 2
            seg = data[at:stop]
            word = ~self.sep[seg]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            cut = inner[np.searchsorted(inner, at, "right") : np.searchsorted(inner, stop)] - at
            first[cut] = word[cut]
            last[cut - 1] = word[cut - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(s):
                padded = np.zeros(len(seg) + 8, np.uint8)
                padded[:-8] = self.lowered[seg] if self.lower else seg
                firsts = [np.where(e - s > k, hash_words(padded, s, s + k), _U(0)) for k in self.heads]
                h, *second = hash_words(padded, s, e, True) if self.both else (hash_words(padded, s, e),)
                out.append((h, s + at, e + at, *firsts, *second))
            at = stop
        none = np.zeros(0, np.uint64)
        h, s, e, *firsts = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, np.zeros(0, np.int64), np.zeros(0, np.int64), *[none for _ in self.heads], *([none] if self.both else []))
        second = [firsts.pop()] if self.both else []
        return (h, s, e, np.searchsorted(s, bounds), *([firsts] if self.heads else []), *second)


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a run of words from those of its two parts."""
    return _mix(a * _U(0xA0761D6478BD642F) + b)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by doubling; the caller leaves out those that cross texts."""
    run, at, power, size = None, 0, h, 1
    while True:
        if k & size:
            if run is None:
                run = power
            else:
                n = max(0, len(h) - at - size + 1)
                run = join_hash(run[:n], power[at : at + n])
            at += size
        if at == k:
            return run if k & (k - 1) or k > 1 else h.copy()
        power = join_hash(power[: max(0, len(power) - size)], power[size:])
        size *= 2


def wide_grams(h: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """The same from both hashes of the words: runs collide only if the sum of two unlike functions does."""
    return grams(h, k) ^ _stir(grams(second, k))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Of the runs of k words over all texts, those that stay in one text. first: words before each text."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    lens = np.diff(first)
    keep = lens >= k
    np.add.at(ok, first[:-1][keep], 1)
    np.add.at(ok, first[1:][keep] - k + 1, -1)
    return np.cumsum(ok)[: max(0, n - k + 1)] > 0


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), bounds


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """A compact form of unsigned numbers: differences if ascending, only the bytes in use, one plane after another, zstandard."""
    v = np.ascontiguousarray(values, np.uint64)
    if ascending and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width | ascending << 7]) + len(v).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0] & 0x7F, int.from_bytes(blob[1:5], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5:]) if n else b"", np.uint8).reshape(width, n)
    v = np.zeros((n, 8), np.uint8)
    v[:, :width] = planes.T
    v = v.view("<u8").reshape(-1).astype(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if blob[0] & 0x80 else v


def origin(docs: DataFrame, n: int, id_col: str, text_col: str, name: str = "origin") -> DataFrame:
    """Deals documents to n groups of bounded size by their id (rows without one by their text)."""
    return docs.withColumn(name, F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(n)).cast("int"))


def tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each stands there; by a plain sort, which is the fastest for 64-bit numbers."""
    v = np.sort(values)
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    heads = np.flatnonzero(new)
    return v[heads], np.diff(np.append(heads, len(v)))


def in_sorted(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place in an ascending table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values

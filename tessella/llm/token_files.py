"""Token-id files: a zstandard dictionary shared by all, one frame for each document, an offset index for each shard.

`write_token_files` makes below one folder
- `dictionary`: its bytes (trained on the serialized id arrays of a bounded sample) and their SHA-256;
- `shards`: one row for each shard, in ascending document order: partition and number, first and last id, dictionary
  hash, documents, tokens, tokens before it in its partition, an index (for each document id, offset, bytes and tokens, all 64-bit) and the frames.
Everything is written by Spark's Parquet writer, so any store that Spark writes to will do. A short-document access
prunes shards by first and last id and reads one index and one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, parts, tune, volume
from tessella.llm.tokens import encoder

_SHARDS = "part int, number int, first_id long, last_id long, dictionary string, documents long, tokens long, before long, entries binary, frames binary"


def _dictionary(docs: DataFrame, tokenizer: str, end_id: int, dtype: str, sample: int, size: int) -> bytes:
    """Trained on at most `sample` documents of at most 64 KB, those with the least hashes of their ids."""
    order = F.xxhash64("id")
    least = docs.select(order.alias("o")).distinct().orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    texts = [] if least is None else [r["text"] for r in docs.where((order <= least) & F.octet_length("text").between(1, 1 << 16)).select("text", order.alias("o")).orderBy("o", "text").limit(sample).collect()]
    arrays = [np.append(np.frombuffer(encoder(tokenizer).encode(t), "<u4"), end_id).astype(dtype).tobytes() for t in texts]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short: their own bytes serve as the dictionary
        return b"".join(arrays)[-size:]


def _codec(dictionary: bytes, level: int | None = None):
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if len(dictionary) >= 8 else {}
    return zstandard.ZstdDecompressor(**shared) if level is None else zstandard.ZstdCompressor(level=level, **shared)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20, level: int = 3, sample: int = 512, dictionary_bytes: int = 32 << 10, group_bytes: int = 8 << 20) -> None:
    """Encodes every whole text (null: empty), adds `end_id`, and writes the files in ascending document id.

    Ids are numbers; rows that share an id keep all their copies, side by side in the order of their texts' hashes; null ids come first and have no entry to
    be found by. An empty table gives a dictionary and no shards. Other columns are not stored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tune(spark, 4)
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = _dictionary(rows, tokenizer, end_id, dtype, sample, dictionary_bytes)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dtype, bytearray(dictionary))], "dictionary string, dtype string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, pack, end = encoder(tokenizer).encode, _codec(dictionary, level), np.array([end_id], "<u4").tobytes()
        entries: list[tuple[int | None, int, int, int]] = []
        frames: list[bytes] = []
        held = number = before = 0

        def shard() -> pa.RecordBatch:
            index = np.array([(e[0] or 0, *e[1:]) for e in entries], "<i8")
            known = [e[0] for e in entries if e[0] is not None]
            row = [part, number, known[0] if known else None, known[-1] if known else None, name, len(entries), int(index[:, 3].sum()), before, np.array([e[0] is not None for e in entries], np.uint8).tobytes() + index.tobytes(), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], [c.split()[0] for c in _SHARDS.split(", ")])

        for batch in batches:
            for part, key, text in zip(batch["part"].to_pylist(), batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.frombuffer((to_ids(text) if text else b"") + end, "<u4")
                frame = pack.compress(ids.astype(dtype).tobytes())
                if entries and held + len(frame) > shard_bytes:
                    yield shard()
                    before += sum(e[3] for e in entries)
                    entries, frames, held, number = [], [], 0, number + 1
                entries.append((key, held, len(frame), len(ids)))
                frames.append(frame)
                held += len(frame)
        if entries:
            yield shard()

    n = parts(spark, volume(rows)[1], group_bytes)
    rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h", "text").select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(batches_of(shards), _SHARDS).write.parquet(f"{path}/shards")


def _entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 33
    return np.frombuffer(blob[:n], np.uint8).astype(bool), np.frombuffer(blob[n:], "<i8").reshape(n, 4)


def _opened(spark: SparkSession, path: str) -> tuple[str, str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["bytes"]).hexdigest() != row["dictionary"]:
        raise ValueError("the dictionary does not match its hash")
    return row["dictionary"], row["dtype"], bytes(row["bytes"])


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """From the files, for each document: id_col, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    name, dtype, dictionary = _opened(spark, path)
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()  # one row for each partition
    base = dict(zip([r["part"] for r in totals], accumulate((r["n"] for r in totals), initial=0), strict=False))
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")], *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError("a shard was written with another dictionary")
                known, index = _entries(row["entries"])
                at, crcs, ids = base[row["part"]] + row["before"], [], []
                for offset, size in index[:, 1:3].tolist():
                    wide = np.frombuffer(unpack.decompress(row["frames"][offset : offset + size]), dtype).astype("<u4")
                    crcs.append(zlib.crc32(wide.tobytes()))
                    if with_ids:
                        ids.append(wide.astype(np.int32))
                n = index[:, 3]
                yield pa.RecordBatch.from_arrays([pa.array(index[:, 0], pa.int64(), mask=~known), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    return shards.select("part", "before", "dictionary", "entries", "frames").mapInArrow(batches_of(decode), schema)


def fetch(spark: SparkSession, path: str, key: int) -> list[list[int]]:
    """The ids of the documents with this id: prunes shards, reads their indexes, then only the frames asked for."""
    _, dtype, dictionary = _opened(spark, path)
    near = spark.read.schema(_SHARDS).parquet(f"{path}/shards").where((F.col("first_id") <= key) & (F.col("last_id") >= key))
    out = []
    for r in near.select("part", "number", "entries").collect():  # one shard, or those that copies of the id fill
        known, index = _entries(r["entries"])
        for _, offset, size, _ in index[known & (index[:, 0] == key)].tolist():
            frame = near.where((F.col("part") == r["part"]) & (F.col("number") == r["number"])).select(F.substring("frames", offset + 1, size)).first()[0]
            out.append(np.frombuffer(_codec(dictionary).decompress(bytes(frame)), dtype).tolist())
    return out

"""Concatenate and cut: packing of token ids into sequences of a fixed length.

Pass one encodes each partition of the documents and writes the ids with their place within the partition. The token
totals of the partitions, one number each, give by prefix sums every partition's global offset. Pass two adds the
offsets and cuts at the multiples of the sequence length; it is narrow. A sequence whose documents lie in two
partitions or more is held together by its boundary records: pieces that share its sequence_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, tune, written
from tessella.llm.tokens import encoder


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Returns the pieces: id_col, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (in its sequence), boundary (its sequence has pieces of another partition) and, if asked for, ids.

    A document's ids are those of its text and `end_id`. All documents in the order of their partitions are one stream,
    cut every `length` ids; only the last sequence is shorter. A null or empty text is `end_id` alone. Rows that share an
    id are packed one by one; a null id is kept. Of an empty table come no pieces. Other columns are left behind.
    """
    spark = docs.sparkSession
    tune(spark, 4)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, total, end = encoder(tokenizer).encode, 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            blobs = [(to_ids(t) if t else b"") + end for t in batch["text"].to_pylist()]
            sizes = np.array([len(b) // 4 for b in blobs], np.int64)
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch["part"], batch["id"], pa.array(starts), pa.array([np.frombuffer(b, "<u4").astype("<u2").tobytes() if narrow else b for b in blobs], pa.binary())], ["part", "id", "at", "ids"])

    from tokenizers import Tokenizer

    narrow = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16
    id_type = docs.schema[id_col].dataType
    stored = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", id_type), T.StructField("at", T.LongType()), T.StructField("ids", T.BinaryType())])
    ids = written(docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches_of(encode), stored))
    width = 2 if narrow else 4
    totals = ids.groupBy("part").agg(F.max(F.col("at") + F.octet_length("ids") / width).cast("long").alias("n")).orderBy("part").collect()  # one row for each partition
    sums = list(accumulate((r["n"] for r in totals), initial=0))
    offsets, ends = {r["part"]: s for r, s in zip(totals, sums, strict=False)}, {r["part"]: s for r, s in zip(totals, sums[1:], strict=True)}
    schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("boundary", T.BooleanType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner, payload = [], [], []
            for k, (part, at, blob) in enumerate(zip(batch["part"].to_pylist(), batch["at"].to_pylist(), batch["ids"].to_pylist(), strict=True)):
                wide = np.frombuffer(blob, "<u2").astype("<u4") if narrow else np.frombuffer(blob, "<u4")
                at += offsets[part]
                left, right = offsets[part], ends[part]
                for seq in range(at // length, (at + len(wide) - 1) // length + 1):
                    a, b = max(at, seq * length), min(at + len(wide), (seq + 1) * length)
                    piece = wide[a - at : b - at]
                    crosses = seq * length < left or ((seq + 1) * length > right and right < sums[-1])
                    rows.append((a - at, b - a, zlib.crc32(piece.tobytes()), len(wide), seq, a - seq * length, crosses))
                    owner.append(k)
                    if with_ids:
                        payload.append(piece.astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.bool_()), *([pa.array(payload, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    return ids.mapInArrow(batches_of(cut), schema)


def assemble(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """From pieces with ids: sequence_id and its ids, padded to `length` unless their number is a power of two."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # `length` ids at most
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    size = F.size("ids")
    pads = F.when(F.bit_count(size) == 1, F.lit(0)).otherwise(F.lit(length) - size)
    return parts.select("sequence_id", ids.alias("ids")).select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), pads.cast("int"))).alias("ids"))

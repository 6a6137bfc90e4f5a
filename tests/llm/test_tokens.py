import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm.packing import assemble, pack_documents
from tessella.llm.token_files import fetch, read_token_files, write_token_files
from tessella.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  a", "a  b", "a \nb", " a", "a ", "\n", "a  b", "a ́b", "Á x", "<|endoftext|> a<|endoftext|>b", "it's we'll 12345 ½", "ΣΑΣ ΟΔΟΣ Σ", "\x1c a\x1c b", "a\r\n b", "日本語 テスト", "x" * 5000, "é", "  a  b", "İI ı"]


@pytest.mark.parametrize("name", NAMES)
def test_cached_encoding_is_the_tokenizers(name):
    t, e = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    assert e.mode != "whole"
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(["a", "B ", " ", "\n", "é", ".", " the", "'s", "1", "́", "\t"]) for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    for x in texts + ODD:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def made():
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (3, ODD[3]), (7, "the " * 9000), (-5, "below")]
    return rows + [(200 + i, "same text here") for i in range(300)]


def ids_of(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [end]


def check_pieces(pieces, docs, encode, length):
    want = sorted(((d, encode(t)) for d, t in docs), key=str)
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == max(by_seq)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for d, ids in want:
        for p in [p for p in by_doc[d] if p.doc_tokens == len(ids)]:
            if zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32:
                by_doc[d].remove(p)
    assert sum(p.length for p in pieces) == sum(len(i) for _, i in want)
    assert not any(by_doc.values())


@pytest.mark.parametrize("length", [7, 64, 2048])
def test_packing(spark, length):
    docs = made()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    pieces = pack_documents(df, public_tokenizers.path(NAMES[0]), length, with_ids=True).cache()
    check_pieces(pieces.collect(), docs, ids_of(NAMES[0], 1), length)
    seqs = {r.sequence_id: r.ids for r in assemble(pieces, length).collect()}
    assert all(len(s) == length for k, s in seqs.items() if k != max(seqs))
    assert len(seqs[max(seqs)]) == length or bin(len(seqs[max(seqs)])).count("1") == 1
    assert pack_documents(df.limit(0), public_tokenizers.path(NAMES[0])).count() == 0


def test_token_files(spark, tmp_path):
    docs = made()
    encode, path = ids_of(NAMES[1], 2), f"file://{tmp_path}/a"
    write_token_files(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), path, public_tokenizers.path(NAMES[1]), shard_bytes=2000)
    rows = read_token_files(spark, path, with_ids=True).collect()
    assert sorted([(r.doc_id, r.ids) for r in rows], key=str) == sorted([(d, encode(t)) for d, t in docs], key=str)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None]
    assert keys == sorted(keys)
    assert fetch(spark, path, 250) == [encode("same text here")] and len(fetch(spark, path, 3)) == 2 and fetch(spark, path, 10**9) == []
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"{path}-none", public_tokenizers.path(NAMES[1]))
    assert read_token_files(spark, f"{path}-none").count() == 0


def test_whole_tables(spark):
    from tessella.llm.queries import op6_packing, op9_token_files

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check_pieces(op6_packing(spark, d).collect(), docs, ids_of(NAMES[0], 1), 2048)
    at, want, encode = 0, [], ids_of(NAMES[1], 2)
    for i, t in sorted(docs):
        ids = encode(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op9_token_files(spark, d).collect()) == want

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessella.llm.token_alignment import Bits, align_tokens
from tessella.llm.tokens import _SHOWN

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a", " ", "  a", "a  b", "a \nb", " a ", "\n", "<|endoftext|> a<|endoftext|>", "<s> x</s><unk> <0x41>", "a▁b", "▁", "日本語 テスト 🙂", "ﬁ é é ´ x", "x" * 3000, "it's we'll 12345 ½", "a\x00b", "﻿a", "tab\t end\t", "é" * 50 + " " + "ß,." * 20, "İI ı", "naïve naïve naïve, the naïve"]


def brute(docs):
    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    byte = {chr(v): k for k, v in _SHOWN.items()}
    rows, seen = [], Counter()
    for d, text in docs:
        a, b, links, groups = [], [], [], []
        if text:
            want = (" " + text).encode()
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            xa = [bytes([byte[c] for c in ta.id_to_token(i)]) for i in a]
            xb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, tb.id_to_piece(i)) for i in b)]
            if b"".join(xa) != want or b"".join(xb) != want:
                a, b = [], []
        if a:
            ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
            i = j = 0
            for cut in sorted(set(ea) & set(eb)):
                p, q = ea.index(cut) + 1, eb.index(cut) + 1
                groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                i, j = p, q
            sa, sb = [0, *ea], [0, *eb]
            k = 0
            for i in range(len(a)):
                while sb[k + 1] <= sa[i]:
                    k += 1
                j = k
                while j < len(b) and sb[j] < sa[i + 1]:
                    links.append((a[i], b[j]))
                    j += 1
            seen.update(set(links))
        rows.append((d, a, b, groups, links))
    top = Counter()
    for (x, _), n in seen.items():
        top[x] = max(top[x], n)
    out = []
    for d, a, b, groups, links in rows:
        text = ";".join(groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(seen[x] == top[x[0]] for x in links), sum(seen[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else "", text))
    return sorted(out, key=str)


def run(spark, docs, parts=3, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as pair", "2 as part").repartition(parts)
    return sorted([tuple(r) for r in align_tokens(df, A, B, with_groups=True, **more).collect()], key=str)


def made():
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice(["a", "B ", " ", "\n", "é", ".", " the", "'s", "1", "́", "\t", "▁", "Ende ", "straße", "日"]) for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    docs = list(enumerate(texts)) + [(1000, None), (None, "no id"), (1001, ""), (3, "a  b"), (7, "the cat " * 9000), (-5, "below")]
    return docs + [(2000 + i, "same text here, naïve") for i in range(200)]


@pytest.mark.parametrize("frequent", [2_000_000, 40, 0])
def test_equals_brute_force(spark, frequent):
    docs = made()
    assert run(spark, docs, frequent=frequent) == brute(docs)


def test_empty_tables_and_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_rank_and_select():
    rnd = np.random.default_rng(1)
    for size in (1, 62, 63, 64, 65, 127, 128, 1000):
        places = np.unique(rnd.integers(0, size + 1, size))
        bits = Bits.at(places, size)
        assert bits.select().tolist() == places.tolist()
        assert bits.rank(np.arange(size + 2)).tolist() == [int((places < p).sum()) for p in range(size + 2)]


def test_whole_table(spark):
    from tessella.llm.queries import op12_tokenizer_alignment

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op12_tokenizer_alignment(spark, d).collect()], key=str) == [r[:-1] for r in brute(docs)]

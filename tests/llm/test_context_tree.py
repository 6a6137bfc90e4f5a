import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.context_tree import _block, _log_gamma, score_texts
from tests.llm.test_substring_dedup import THUE_MORSE


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """Context-tree weighting by its definition, node by node."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.kids = depth, Counter(), {}
        for t in texts:
            data = b"\n" * depth + b" ".join((t or "").encode().lower().split()) + b"\n"
            for i in range(depth, len(data)):
                for j in range(8):
                    prefix, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
                    for d in range(depth + 1):
                        self.counts[data[i - d : i], prefix, bit] += 1
                        if d < depth:
                            self.kids.setdefault((data[i - d : i], prefix), set()).add(data[i - d - 1 : i])
        self.weighted = cache(self._weighted)

    def pair(self, context, prefix):
        return self.counts[context, prefix, 0], self.counts[context, prefix, 1]

    def _weighted(self, context, prefix):
        own = kt(*self.pair(context, prefix))
        if len(context) == self.depth:
            return own
        under = sum(self.weighted(c, prefix) for c in self.kids.get((context, prefix), ()))
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + under)

    def score(self, text):
        data, total = b"\n" * self.depth + b" ".join((text or "").encode().lower().split()) + b"\n", 0.0
        for i in range(self.depth, len(data)):
            for j in range(8):
                prefix, bit, p = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1, None
                for d in range(self.depth, -1, -1):
                    c = data[i - d : i]
                    n = self.pair(c, prefix)
                    est = (n[bit] + 0.5) / (sum(n) + 1)
                    if p is None:
                        p = est
                    else:
                        w = math.exp(math.log(0.5) + kt(*n) - self.weighted(c, prefix))
                        p = w * est + (1 - w) * p
                total += math.log10(p)
        return total


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def learn():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0


def brute(rows, depth):
    train = [t for i, t in rows if i is not None and not held_out(i)]
    c = Counter(w for t in train for w in (t or "").encode().lower().split() + [None])
    n, v, tree = sum(c.values()), len(c), Brute(train, depth)
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [None]
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), tree.score(t)))
    return sorted(out, key=str)


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(w[5], rel=1e-5), (g, w)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_matches_definition(spark, depth):
    rnd = random.Random(depth)
    rows = [(i, rnd.choice(["  ", " ", "\n"]).join(rnd.choice(["the", "The", "né", "ab", "abc", "x1"]) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the ab"), (None, None), (5, rows[5][1]), (102, "ab " * 400)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), learn(), depth, group_bytes=300).collect()
    close(sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=str), brute(rows, depth))


def test_split_answers_and_rounds_of_merging(spark, monkeypatch):
    """Buckets that answer in several tasks, tables merged in three rounds, and keys held in small heaps."""
    from tessella.llm import context_tree as C

    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "then", "né", "ab", "abc"]) for _ in range(rnd.randint(0, 9)))) for i in range(90)] + [(90, None), (None, "then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = score_texts(docs, learn(), 4, group_bytes=200, ask_keys=20).collect()
    close(sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=str), brute(rows, 4))
    base = docs.select(F.col("doc_id").alias("id"), "text", F.lit(True).alias("learn"))
    read = lambda df: sorted((r.kind, r.bucket, C.unpack(r["keys"]).tolist(), C.unpack(r["counts"]).tolist(), r.known, r.total) for r in df.collect())
    once = read(C.count_tables(base, 4, 3, 1))
    monkeypatch.setattr(C, "_FAN", 2)
    assert once and read(C.count_tables(base, 4, 3, 4)) == once


def test_heap_merges():
    from tessella.llm import context_tree as C

    held, rnd = C._Held(), np.random.default_rng(1)
    old, C._HELD = C._HELD, 50
    try:
        every = [rnd.integers(0, 40, 30).astype(np.uint64) for _ in range(7)]
        for x in every:
            keys, n = C.tally(x)
            held.add(keys, n)
        keys, n = held.merged()
    finally:
        C._HELD = old
    want = Counter(np.concatenate(every).tolist())
    assert keys.tolist() == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_edges(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), learn()).count() == 0
    none = score_texts(spark.createDataFrame([(1, "ab", 3)], "doc_id long, text string, score long"), F.lit(False)).collect()
    assert none[0].n_known == 0 and none[0].train_tokens == 0 and none[0].score == pytest.approx(3 * 8 * math.log10(0.5)) and none[0].bits_per_byte == pytest.approx(8)
    with pytest.raises(ValueError):
        score_texts(spark.createDataFrame([], "doc_id long, text string"), learn(), 6)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.0, 7.5, 100.5, 1e7 + 0.5])
    assert np.allclose(_log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    assert _block(np.array([0.0]), np.array([0.0]))[0] == pytest.approx(0, abs=1e-12)


def test_whole_table(spark):
    from tessella.llm.queries import op5_lm_scoring

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op5_lm_scoring(spark, d).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in got)
    train = [t for i, t in rows if not held_out(i)]
    c = Counter(w for t in train for w in t.encode().lower().split() + [None])
    n, v, texts = sum(c.values()), len(c), dict(rows)
    for r in got:
        w = texts[r.doc_id].encode().lower().split() + [None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    held = [r for r in got if r.held_out]
    size = sum(len(b" ".join(texts[r.doc_id].encode().split())) + 1 for r in held)
    assert -sum(r.score for r in held) * math.log2(10) / size < 3  # bits per byte; a byte without a model takes 8


def test_words_that_fool_polynomials(spark):
    docs = spark.createDataFrame([(0, THUE_MORSE[0]), (1, THUE_MORSE[1]), (2, THUE_MORSE[0])], "doc_id long, text string")
    got = {r.doc_id: r.n_known for r in score_texts(docs, F.col("doc_id") == 0).collect()}
    assert got == {0: 2, 1: 1, 2: 2}

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm.best_fit import best_fit_pack, plan

NAME = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(counts, top):
    """Rooms of the bins after best-fit decreasing, a piece at a time."""
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms[rooms.index(min(fit))] -= size
            else:
                rooms.append(top - size)
    return sorted(rooms)


@pytest.mark.parametrize("top", [1, 2, 7, 50, 128])
def test_plan_is_best_fit_decreasing(top):
    rnd = random.Random(top)
    for _ in range(60):
        counts = {rnd.randint(1, top): rnd.randint(1, 30) for _ in range(rnd.randint(0, 12))}
        bins, runs, places = {}, plan(counts, top), Counter()
        for size, rank, first, each, offset in runs.tolist():
            ends = [r[1] for r in runs.tolist() if r[0] == size and r[1] > rank]
            for i in range(min(ends, default=counts[size]) - rank):
                bins.setdefault(first + i // each, []).append((offset + i % each * size, size))
                places[size] += 1
        assert places == Counter(counts)
        assert sorted(bins) == list(range(len(bins)))
        for b in bins.values():
            at = 0
            for offset, size in sorted(b):
                assert offset == at
                at += size
            assert at <= top
        assert sorted(top - sum(s for _, s in b) for b in bins.values()) == one_by_one(counts, top)


def check(rows, docs, length):
    t = Tokenizer.from_file(NAME)
    want, sizes = Counter(), Counter()
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), length)):
            x = ids[at : at + length]
            want[d, piece, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
            sizes[len(x)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(length - sum(n for _, n in s) for s in seqs.values()) == one_by_one(sizes, length)


@pytest.mark.parametrize("length", [1, 7, 64, 4096])
def test_packing(spark, length):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["the", "cat", "naïve", "x"]) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    docs += [(1000, None), (None, "no id"), (1001, ""), (3, "again"), (3, "again"), (7, "the " * 9000)] + [(2000 + i, "same text") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as part", "'x' as length", "2 as rank").repartition(5)
    check(best_fit_pack(df, NAME, length).collect(), docs, length)
    assert best_fit_pack(df.limit(0), NAME, length).count() == 0


def test_ids_come_along(spark):
    docs = [(1, "a cat sat " * 10), (2, None)]
    rows = best_fit_pack(spark.createDataFrame(docs, "doc_id long, text string"), NAME, 8, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length


def test_whole_table(spark):
    from tessella.llm.queries import op13_best_fit_packing

    d = "/root/testdata/sf0.001"
    check(op13_best_fit_packing(spark, d).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()], 4096)

import random
import re

import pytest

from tessella.llm.graph import components
from tessella.llm.jaccard_join import jaccard_join
from tests.llm.test_substring_dedup import THUE_MORSE


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        (a, s), (b, t) = sets[i], sets[j]
        if a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted([(d, len(s), None if d is None else find(d)) for d, s in sets], key=str)


def made(seed, n=120):
    rnd = random.Random(seed)
    v = [f"w{i}" for i in range(80)]
    bases = [[rnd.choice(v) for _ in range(rnd.randint(1, 60))] for _ in range(14)]
    rows = []
    for d in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[], [rnd.choice(v)], [rnd.choice(v), rnd.choice(v)]])
            w = w or ["one"]
        rows.append((d, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  B"), (n + 4, "a b c d e"), (None, rows[0][1]), (None, None), (7, rows[7][1]), (8, rows[20][1]), (n + 5, "z " * 20000), (n + 6, "z " * 9)]
    rows += [(1000 + i, rows[11][1]) for i in range(60)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 5, 75), (2, 3, 60), (3, 1, 100), (4, 5, 90)])
def test_matches_brute_force(spark, seed, k, percent):
    rows = made(seed)
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, group_bytes=6000, block=7)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, k, percent)


def test_edges(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", None)], "doc_id long, text string, component_id long")
    assert sorted(tuple(r) for r in jaccard_join(odd).collect()) == [(1, 2, 1), (2, 2, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (5, 5), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_whole_table(spark):
    from tessella.llm.queries import op3_ngram_jaccard_join

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in op3_ngram_jaccard_join(spark, d).collect()], key=str) == brute(rows, 5, 75)


def test_words_that_fool_polynomials(spark):
    rest = " ".join(f"w{i}" for i in range(8))
    rows = [(i, f"{a} {rest} {b}") for i, (a, b) in enumerate([THUE_MORSE, THUE_MORSE[::-1], THUE_MORSE])]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 75).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 5, 75) == [(0, 6, 0), (1, 6, 1), (2, 6, 0)]

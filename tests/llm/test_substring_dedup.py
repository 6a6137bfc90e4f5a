import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.substring_dedup import _matched, substring_dedup

#: A word and its complement, of one hash under any polynomial modulo 2 ** 64.
THUE_MORSE = ["".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba")]


def brute(rows, n):
    """rows: (doc_id, text) -> {(doc_id, text): [(n_words, n_removed, sha)]}"""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if d is not None:
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            m = least.get(tuple(w[i : i + n]))
            if m is not None and (d is None or m < d):
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß"]
    shared = [[rnd.choice(words) for _ in range(rnd.randint(5, 40))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += rnd.choice(shared) if rnd.random() < 0.6 else [rnd.choice(words) for _ in range(rnd.randint(1, 30))]
        rows.append((d, rnd.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[3][1]), (None, None), (5, rows[5][1]), (5, rows[7][1]), (n + 3, "a " * 30000), (n + 4, "a " * 200), (n + 5, "x" * 300000)]
    rows += [(100 + i, rows[9][1]) for i in range(50)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,levels", [(8, 1), (8, 2), (8, 0), (20, 2), (7, 2), (13, 3)])
def test_matches_brute_force(spark, words, levels):
    rows = made(words + levels)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, words, levels, group_bytes=20000, bucket_runs=500)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()], key=str) == brute(rows, words)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "q", 3), (2, "z a b c d y", None, None)], "doc_id long, text string, n_words string, kept int")
    rows = {r.doc_id: r for r in substring_dedup(df, 4, 1).collect()}
    assert rows[1].n_removed == 0 and rows[2].kept == "z y" and rows[2].spans == [[1, 5]] and rows[1].rest.n_words == "q"
    assert {r.n_removed for r in substring_dedup(df, 50, 2).collect()} == {0}


def test_words_that_fool_polynomials(spark):
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(i, f"{rest} {w}") for i, w in enumerate([*THUE_MORSE, THUE_MORSE[0]])]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == brute(rows, 50)
    assert sorted(r.n_removed for r in got) == [0, 0, 50]


def test_unlike_runs_of_one_hash_are_told_apart():
    table, twin = np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 4, 1], np.uint64)
    runs, twins = np.array([5, 5, 5, 5, 9, 9, 3, 4], np.uint64), np.array([1, 2, 3, 4, 1, 2, 2, 1], np.uint64)
    place, hit = _matched(table, twin, runs, twins)
    assert hit.tolist() == [True, True, False, True, True, False, False, False] and place[hit].tolist() == [1, 2, 3, 4]


def test_whole_table(spark):
    from tessella.llm.queries import op1_substring_dedup

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = op1_substring_dedup(spark, d)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, 50)
    assert got.agg(F.sum("n_removed")).first()[0] > 0

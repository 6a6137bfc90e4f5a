import hashlib
import random
import re

import pytest

from tessella.llm.decontaminate import decontaminate
from tests.llm.test_substring_dedup import THUE_MORSE


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n):
    table = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            table.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes = {len(x) for x in table}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                if (x := tuple(w[a : a + size])) in table:
                    hit.update(range(a, a + size))
                    found |= table[x]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def made(seed):
    rnd = random.Random(seed)
    v = [f"w{i}" for i in range(60)] + ["É", "straße", "A1"]
    items = [(i, rnd.choice([" ", ", ", "-"]).join(rnd.choice(v) for _ in range(rnd.choice([2, 4, 9, 10, 11, 25])))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "..."), (None, "only one without an id has these ten words in it here"), (3, items[7][1])]
    docs = []
    for d in range(80):
        w = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5:
                x = words(rnd.choice(items)[1])
                a = rnd.randint(0, max(0, len(x) - 5))
                w += x[a : a + rnd.randint(3, 30)]
            w += [rnd.choice(v) for _ in range(rnd.randint(0, 20))]
        docs.append((d, rnd.choice([" ", "; "]).join(w)))
    docs += [(200, None), (201, ""), (202, items[-2][1].upper()), (None, items[4][1]), (5, docs[5][1]), (203, "w1 " * 20000)]
    return docs, items


@pytest.mark.parametrize("window,k,limit", [(10, 5, 1 << 20), (10, 5, 0), (6, 2, 1 << 20), (6, 6, 0), (1, 1, 1 << 20)])
def test_matches_brute_force(spark, window, k, limit):
    docs, items = made(window + k)
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, k, broadcast_bytes=limit, group_bytes=5000)
    rows = got.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=str) == brute(docs, items, window)
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in rows)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_edges(spark, limit):
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate(docs, none, broadcast_bytes=limit - 1).first()
    assert (row.n_words, row.n_hit, row["items"], row.rest["items"]) == (3, 0, [], "x")
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"), broadcast_bytes=limit).count() == 0


def test_whole_table(spark):
    from tessella.llm.queries import op10_benchmark_decontamination

    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items, 10)]
    assert sorted([tuple(r) for r in op10_benchmark_decontamination(spark, d).collect()], key=str) == sorted(want, key=str)
    assert sum(w[5] for w in want) > 0


def test_words_that_fool_polynomials(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    items = [(0, f"{THUE_MORSE[0]} {rest}"), (1, THUE_MORSE[1])]
    docs = [(0, f"{THUE_MORSE[1]} {rest[:20]} x"), (1, f"{THUE_MORSE[0]} {rest}"), (2, f"x {THUE_MORSE[0]} y")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got], key=str) == brute(docs, items, 10)

import itertools

import numpy as np
import pytest

from tessella.operators import linkage as L


def merge_one_by_one(d: dict, how: str) -> list[tuple]:
    """The same tree by its definition, for small tables: d[(a, b)] with a before b; returns (left, right, height)."""
    size, out = {x: 1 for pair in d for x in pair}, []
    while d:
        (a, b), h = min(d.items(), key=lambda e: (e[1], e[0]))
        out.append((a, b, h))
        new: dict = {}
        for (x, y), v in d.items():
            if {x, y} == {a, b}:
                continue
            p, q = sorted((a if x == b else x, a if y == b else y))
            new.setdefault((p, q), []).append((v, size[x] * size[y]))
        d = {k: min(v)[0] if how == "single" else max(v)[0] if how == "complete" else float(np.dot(*zip(*v, strict=True)) / sum(w for _, w in v)) for k, v in new.items()}
        size[a] += size.pop(b)
    return out


def made(n=14, seed=3, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, 2)).astype(float) if ties else rng.standard_normal((n, 3))
    return {(f"s{i:02d}", f"s{j:02d}"): float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for i, j in itertools.combinations(range(n), 2)}


@pytest.mark.parametrize("how", L.LINKAGES)
def test_tree_equals_one_by_one(spark, how):
    d = made()
    df = spark.createDataFrame([(b, a, v) if i % 2 else (a, b, v) for i, ((a, b), v) in enumerate(d.items())], "a string, b string, d double").repartition(4)
    merges = L.linkage(df, how)
    got = merges.orderBy("step").collect()
    want = merge_one_by_one(dict(d), how)
    assert [(r.left, r.right) for r in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([r.height for r in got], [h for _, _, h in want], atol=1e-12) and got[-1].size == 14
    for k in (1, 3):
        of = {f"s{i:02d}": f"s{i:02d}" for i in range(14)}
        for a, b, _ in want[: 14 - k]:
            of = {s: a if c == b else c for s, c in of.items()}
        numbers = {c: i for i, c in enumerate(sorted(set(of.values())))}
        labels = spark.createDataFrame([(s,) for s in of], "s string")
        assert {r.s: r.cluster for r in L.cut(merges, labels, "s", k).collect()} == {s: numbers[c] for s, c in of.items()}


def test_ties_and_small_tables(spark):
    d = made(9, 5, ties=True)
    df = spark.createDataFrame([(*k, v) for k, v in d.items()], "a string, b string, d double")
    got = L.linkage(df, "single").collect()
    assert np.allclose(sorted(r.height for r in got), sorted(h for _, _, h in merge_one_by_one(dict(d), "single")))
    assert L.linkage(df.limit(0)).count() == 0
    tree = {r.node: r for r in L.upgma(spark.createDataFrame([("x", "y", 2.0), ("x", "z", 6.0), ("y", "z", 8.0)], "a string, b string, d double")).collect()}
    assert {n: (r.parent, r.length, r.is_leaf) for n, r in tree.items()} == {"x": ("node1", 1.0, True), "y": ("node1", 1.0, True), "node1": ("node2", 2.5, False), "z": ("node2", 3.5, True), "node2": (None, 0.0, False)}


def test_distances_fill_with_means(spark):
    cells = [("a", "f", 1.0), ("a", "g", 2.0), ("b", "f", 3.0), ("b", "g", None), ("c", "g", 4.0), ("c", "h", None), (None, "f", 9.0)]
    df = spark.createDataFrame(cells, "s string, f string, v double")
    x = np.array([[1, 2], [3, 3], [2, 4]])
    got = {(r.a, r.b): r.d for r in L.distances(df.where("s is not null"), "s", "f", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (i, p), (j, q) in itertools.combinations(enumerate("abc"), 2):
        assert abs(got[p, q] - np.sqrt(((x[i] - x[j]) ** 2).sum())) < 1e-12
    assert {r.s: r.cluster for r in L.hierarchical_clustering(df, "s", "f", "v", 2).collect()}.keys() == {"a", "b", "c"}

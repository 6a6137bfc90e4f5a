import numpy as np
import pytest

from tessella.llm.vector_graph import near_duplicates, robust_prune


def brute(rows, threshold):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    n = {}
    groups = {}
    for i, v, lab in ok:
        groups.setdefault((lab, len(v)), []).append((i, v))
    for g in groups.values():
        ids, x = [i for i, _ in g], np.array([v for _, v in g])
        x = x / np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            n[ids[a]] = n.get(ids[a], 0) + 1
            n[ids[b]] = n.get(ids[b], 0) + 1
            p, q = find(ids[a]), find(ids[b])
            up[max(p, q)] = min(p, q)
    return {i: (n.get(i, 0), find(i)) for i, _, _ in rows if i is not None}


def made(seed, n=700, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 2, 3):
        x[i] = x[rng.integers(n // 2, n)] + rng.normal(size=dim) * rng.choice([0.01, 0.2, 0.4])
    x[100:220] = x[99] + rng.normal(size=(120, dim)) * 0.12
    x[300:340] = x[299]
    rows = [(int(i), [float(v) for v in x[i]], int(i % 3) if not 99 <= i < 345 else 1) for i in range(n)]
    bad = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), rows[0][1][:5]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(2000, rows[5][1], None), (2001, rows[299][1], 2), (2002, rows[300][1], 1), (2003, [5 * v for v in rows[300][1]], 1)]
    return rows


def judge(got, want, exact=False):
    assert sorted(got) == sorted(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found == there if exact else found >= 0.9 * there
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97


@pytest.mark.parametrize("part_size,share", [(1024, 256), (50, 100)])
def test_recall_against_brute_force(spark, part_size, share):
    rows = made(part_size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = near_duplicates(df, share=share, part_size=part_size).collect()
    judge({r.vec_id: (r.n_links, r.component_id) for r in out}, brute(rows, 0.98))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, kept string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, None), (None, [1.0, 0.0], 1, None), (9, [0.0, 1.0], 1, None)]
    got = sorted((tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(3, 1, 2, False), (2, 1, 2, True), (None, 0, None, False), (9, 0, 9, True)], key=str)


def test_robust_prune_keeps_the_nearest_and_drops_the_hidden():
    x = np.array([[1, 0, 0], [0.99, 0.14, 0], [0.97, 0.24, 0], [0, 0, 1.0]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    kept = robust_prune(x @ x.T, 2, 1.2, 3)
    assert kept[0, 0] == 1 and 2 not in kept[0]


def test_whole_table(spark):
    from tessella.llm.queries import op2_embedding_near_dedup

    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    judge({r.vec_id: (r.n_links, r.component_id) for r in op2_embedding_near_dedup(spark, d).collect()}, brute(rows, 0.98))


@pytest.mark.parametrize("kind,label", [("string", str), ("long", lambda x: x + 2**40)])
def test_labels_of_other_types(spark, kind, label):
    rows = [(i, v, None if lab is None else label(lab)) for i, v, lab in made(7, 350)]
    out = near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()
    judge({r.vec_id: (r.n_links, r.component_id) for r in out}, brute(rows, 0.98))


def test_what_the_graph_misses_is_compared_exactly(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = near_duplicates(df, share=100, part_size=60, least_recall=1.0, rounds=0).collect()
    judge({r.vec_id: (r.n_links, r.component_id) for r in out}, brute(rows, 0.98), exact=True)
    assert {r.recall for r in out} == {1.0}

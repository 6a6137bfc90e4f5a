import math

import numpy as np
import pytest

from tessella.llm.whitening import whiten


def brute(vectors, k):
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}), float)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(v) for v in x.values()}, strict=True)]
    c = fit - fit.mean(axis=0)
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        w = (np.array(v, float) - fit.mean(axis=0)) @ u[:, :k] / np.sqrt(values[:k])
        for j in range(k):
            out[i, j + 1] = (n, deviation, w[j], values[j] / values.sum())
    return out


def check(rows, want, loose=1e-6):
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == set(want) and len(rows) == len(want)
    for j in {j for _, j in want}:
        keys = [key for key in want if key[1] == j]
        sign = np.sign(sum(got[key].whitened * want[key][2] for key in keys))
        for key in keys:
            r, (n, deviation, w, explained) = got[key], want[key]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.whitened * sign - w) < loose and abs(r.explained - explained) < 1e-9 * explained + 1e-15
            assert 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in rows}) <= 1


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as n", "'a' as _x", "2 as component")


@pytest.mark.parametrize("block", [4, 6, 64])
def test_equals_eigenvectors_of_the_whole(spark, block):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((400, 12)) * 1.25 ** -np.arange(12)).astype(np.float32).tolist()
    vectors = list(enumerate(x)) + [(1000 + i, x[0]) for i in range(300)]
    odd = [(-1, None), (-2, [None] + x[0][1:]), (-3, [float("nan")] + x[0][1:]), (-4, [float("inf")] + x[0][1:]), (-5, [])]
    check(whiten(frame(spark, vectors + odd).repartition(5), 4, block=block).collect(), brute(vectors, 4))


def test_ids_may_repeat_or_miss(spark):
    x = np.random.default_rng(4).standard_normal((30, 3)).tolist()
    rows = whiten(frame(spark, [(None if i % 2 else 7, v) for i, v in enumerate(x)]), 16).collect()
    assert len(rows) == 90 and {r.component for r in rows} == {1, 2, 3}


def test_flat_directions_and_few_vectors(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    rows = whiten(frame(spark, line), 16).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 20 and abs(rows[0].explained - 1) < 1e-12
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whiten(frame(spark, few), 16).collect() == []


def test_far_entries_stay_exact(spark):
    x = [[1e12, 3.0], [-1e12, 1.0], [5.0, 2.0], [1e30, 0.0]]
    vectors = [(i, np.array(v, np.float32).tolist()) for i, v in enumerate(x)]
    rows = whiten(frame(spark, vectors), 1).collect()
    assert len(rows) == 4 and all(r.deviation is None for r in rows if r.vec_id in (0, 1, 3))


def test_whole_table(spark):
    from tessella.llm.queries import op11_embedding_whitening

    d = "/root/testdata/sf0.01"
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(op11_embedding_whitening(spark, d).collect(), brute(vectors, 16))

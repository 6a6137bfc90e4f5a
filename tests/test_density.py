import numpy as np
import pytest

from tessella.operators.density import components, dbscan


def brute(rows, eps, least):
    """By its definition, in order of keys: rows are (key, vector), keys distinct."""
    rows = sorted(rows)
    x = np.array([v for _, v in rows], float)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core, out, k = near.sum(1) >= least, np.full(len(rows), -1), 0
    for i in range(len(rows)):
        if core[i] and out[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if out[j] < 0:
                    out[j] = k
                    if core[j]:
                        stack += np.flatnonzero(near[j] & (out < 0)).tolist()
            k += 1
    return {r[0]: (int(c), bool(b)) for r, c, b in zip(rows, out, core, strict=True)}


def run(spark, rows, eps, least, **more):
    df = spark.createDataFrame(rows, "key long, v array<double>").repartition(5)
    return {r["key"]: (r.cluster, r.core) for r in dbscan(df, "key", "v", eps, least, **more).collect()}


@pytest.mark.parametrize("dims,budget", [(1, None), (2, 0), (2, None), (4, 0)])
def test_equals_brute_force(spark, dims, budget):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(m, 0.7, (45, dims)) for m in (0, 4, -5)] + [rng.uniform(-9, 9, (40, dims)), np.repeat(rng.uniform(-9, 9, (2, dims)), 7, axis=0)])
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(len(x)), x, strict=True)]
    eps, least = (0.12, 4) if dims == 1 else (0.5 * dims**0.5, 5)
    want = brute(rows, eps, least)
    assert len({c for c, _ in want.values()}) > 3 and any(c >= 0 and not b for c, b in want.values())
    assert run(spark, rows, eps, least, budget=budget) == want


def test_distances_of_exactly_eps_and_halving(spark):
    rows = [(i * 6 + j, [float(i), float(j)]) for i in range(6) for j in range(6)] + [(99, [50.0, 0.0])]
    for budget in (0, None):
        assert run(spark, rows, 1.0, 5, budget=budget) == brute(rows, 1.0, 5)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (1, [-0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [])]
    df = spark.createDataFrame(rows, "key long, v array<double>")
    got = sorted((r["key"], r.cluster, r.core) for r in dbscan(df, "key", "v", 1.0, 2).collect() if r.cluster is not None)
    assert got == [(1, 0, True)] * 2
    assert dbscan(df, "key", "v", 1.0, 2).where("cluster is null and not core").count() == 6
    assert dbscan(df.where("key = 99"), "key", "v").count() == 0
    with pytest.raises(ValueError):
        dbscan(df, "key", "v", 0.0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (205, 200), (205, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 205: 200}

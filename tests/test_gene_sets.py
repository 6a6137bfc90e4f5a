import numpy as np

from tessella.operators import gene_sets as G
from tessella.operators import penalised as P


def running_score(values, hits, weight):
    step = np.where(hits, np.abs(values) ** weight, 0)
    step = step / step.sum() if step.sum() > 0 else hits / hits.sum()
    s = np.cumsum(step - ~hits / (~hits).sum())
    return s.max() if s.max() >= -s.min() else s.min()


def test_gsea_equals_the_running_sum(spark):
    rng = np.random.default_rng(8)
    values = np.round(rng.standard_normal(60), 1)
    genes = [f"g{i:02d}" for i in range(60)]
    order = sorted(range(60), key=lambda i: (-values[i], genes[i]))
    member = {s: {g for i, g in enumerate(genes) if rng.random() < (0.5 if values[i] * (1 - 2 * s) > 0.5 else 0.1)} for s in range(4)}
    member[9] = {"g00", "g01"}
    rows = [(g, f"s{s}") for s, m in member.items() for g in m] + [("g00", "s0"), (None, "s0"), ("other", "s1")]
    ranked = spark.createDataFrame([(g, float(v)) for g, v in zip(genes, values, strict=True)] + [("none", None), ("nan", float("nan"))], "gene string, v double")
    sets = spark.createDataFrame(rows, "gene string, set string")
    got = {r["set"]: r for r in G.gsea(ranked, sets, "gene", "v", "set", permutations=30, seed=3, min_size=3).collect()}
    assert set(got) == {"s0", "s1", "s2", "s3"}
    for s in range(4):
        hits = np.array([genes[i] in member[s] or (s == 0 and genes[i] == "g00") for i in order])
        x = values[order]
        es = running_score(x, hits, 1.0)
        null = np.array([running_score(x[G.shuffled(np.arange(60), 60, p + 1, 3)], hits, 1.0) for p in range(30)])
        same = null[null >= 0] if es >= 0 else null[null < 0]
        r = got[f"s{s}"]
        assert r.size == hits.sum() and abs(r.es - es) < 1e-12 and abs(r.nes - es / abs(same.mean())) < 1e-9
        assert abs(r.p - (1 + ((null >= es).sum() if es >= 0 else (null <= es).sum())) / 31) < 1e-12
    assert G.gsea(ranked.limit(0), sets, "gene", "v", "set", permutations=10).count() == 0


def test_shuffles_are_permutations():
    for n in (1, 2, 3, 64, 65, 1000):
        seen = {tuple(G.shuffled(np.arange(n), n, p, 1)) for p in range(4)}
        assert all(sorted(s) == list(range(n)) for s in seen) and (n < 64 or len(seen) == 4)


def test_ssgsea(spark):
    rng = np.random.default_rng(2)
    genes = [f"g{i:02d}" for i in range(20)]
    x = {s: rng.integers(0, 6, 20).astype(float) for s in "AB"}
    member = {"p": {"g01", "g05", "g19"}, "q": set(genes[:10]), "all": set(genes), "far": {"zz"}}
    cells = spark.createDataFrame([(s, g, float(v)) for s in x for g, v in zip(genes, x[s], strict=True)] + [("A", "nan", float("nan"))], "sample string, gene string, v double")
    sets = spark.createDataFrame([(g, s) for s, m in member.items() for g in m], "gene string, set string")
    want = {}
    for s, v in x.items():
        rank = np.array([int((v < a).sum() + ((v == a).sum() + 1) / 2) for a in v])
        order = sorted(range(20), key=lambda i: (-rank[i], genes[i]))
        place = {i: k for k, i in enumerate(order)}
        for name in ("p", "q"):
            idx = [i for i, g in enumerate(genes) if g in member[name]]
            w = rank[idx] ** 0.25
            behind = np.array([20 - place[i] for i in idx])
            want[s, name] = (w * behind).sum() / w.sum() - (210 - behind.sum()) / (20 - len(idx))
    span = max(want.values()) - min(want.values())
    got = {(r.sample, r["set"]): r.score for r in G.ssgsea(cells, sets, "gene", "sample", "v", "set").collect()}
    assert set(got) == set(want) and all(abs(got[k] - v / span) < 1e-12 for k, v in want.items())


def test_penalised_fits_are_optimal(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 4)) * [1, 5, 0.1, 1] + [0, 100, 0, 0]
    x[:, 3] = x[:, 0] * 0.9 + 0.1 * x[:, 3]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.standard_normal(90)
    hole = x.copy()
    hole[::11, 1] = np.nan
    filled = np.where(np.isnan(hole), np.nanmean(hole, axis=0), hole)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], 7.0, float(t)) for i, (r, t) in enumerate(zip(hole, y, strict=True))] + [(99, 1.0, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double, one double, y double").repartition(3)
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)

    def fit(z, y, alpha, l1):
        """The gradient at the optimum: zero, or within the l1 term where the coefficient is zero."""
        return lambda w: z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - l1) * w

    for name, alpha, l1 in (("lasso", 0.2, 1.0), ("elastic_net", 0.3, 0.4)):
        got = {r.feature: r for r in getattr(P, name)(df, "key", "y", ["a", "b", "c", "d", "one"], alpha=alpha, **({} if l1 == 1 else {"l1_ratio": l1})).collect()}
        w = np.array([got[c].coef for c in "abcd"])
        g = fit(z, y, alpha, l1)(w)
        assert got["one"].coef == 0 and got["a"].n == 90
        for v, s in zip(w, g, strict=True):
            assert abs(s - np.sign(v) * alpha * l1) < 1e-9 if v else abs(s) <= alpha * l1 + 1e-9
    got = {r.feature: r for r in P.ridge(df, "key", "y", ["a", "b", "c", "d"], alpha=3.0, folds=3, fold=df.key % 3).collect()}
    w = np.linalg.solve(z.T @ z + 3 * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose([got[c].coef for c in "abcd"], w, atol=1e-10)
    assert abs(got["a"].intercept + filled.mean(axis=0) @ [got[c].slope for c in "abcd"] - y.mean()) < 1e-9
    scores = []
    for k in range(3):
        train, test = np.arange(90) % 3 != k, np.arange(90) % 3 == k
        m, s = filled[train].mean(axis=0), filled[train].std(axis=0)
        u = (filled[train] - m) / s
        b = np.linalg.solve(u.T @ u + 3 * np.eye(4), u.T @ (y[train] - y[train].mean()))
        off = y[test] - y[train].mean() - (filled[test] - m) / s @ b
        scores.append(1 - (off**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    assert abs(got["a"].cv_mean - np.mean(scores)) < 1e-9 and abs(got["a"].cv_std - np.std(scores)) < 1e-9
    assert P.lasso(df.limit(0), "key", "y", ["a"]).count() == 0

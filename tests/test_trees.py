import numpy as np
import pytest

from tessella.operators import trees as M


def grown(x, s, used, spec, t=0, node=0, depth=0, out=None):
    """Brute force: every feature and every place between two values, in the order of the docstring."""
    out = {} if out is None else out
    total = s.sum(axis=0)
    out[node] = total
    score = lambda v: (v[1 : used + 1] ** 2).sum() / v[0]
    if depth == spec.depth or total[0] < spec.min_split or (used > 1 and (total[1 : used + 1] == total[0]).any()):
        return out
    rng = np.random.default_rng([spec.seed, t, node])
    allowed = range(x.shape[1]) if spec.subset is None else np.sort(rng.choice(x.shape[1], min(spec.subset, x.shape[1]), replace=False))
    best = None
    for f in allowed:
        values = np.unique(x[s[:, 0] > 0, f])
        cuts = (values[:-1] + values[1:]) / 2
        if not len(cuts):
            continue
        if spec.random_cuts:
            at = min(int(np.searchsorted(cuts, values[0] + rng.random() * (values[-1] - values[0]))), len(cuts) - 1)
            cuts = cuts[at : at + 1]
        for c in cuts:
            go = x[:, f] > c
            left, right = s[~go].sum(axis=0), s[go].sum(axis=0)
            if min(left[0], right[0]) < spec.min_leaf:
                continue
            gain = score(left) + score(right)
            if best is None or gain > best[0] + 1e-12 * abs(best[0]):
                best = (gain, f, c)
    if best is None or best[0] <= score(total) * (1 + 1e-12):
        return out
    go = x[:, best[1]] > best[2]
    out[node, "split"] = (best[1], best[2])
    grown(x[~go], s[~go], used, spec, t, 2 * node + 1, depth + 1, out)
    grown(x[go], s[go], used, spec, t, 2 * node + 2, depth + 1, out)
    return out


def leaf(tree, row):
    node = 0
    while (node, "split") in tree:
        f, c = tree[node, "split"]
        node = 2 * node + 1 + (row[f] > c)
    return tree[node]


def made(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 4, n), rng.integers(0, 30, n) / 4, np.ones(n)])
    y = np.round(3 * (x[:, 0] > 4) + x[:, 1] * (x[:, 2] > 3) + rng.integers(0, 3, n))
    label = np.where(y > 5, "high", np.where(y > 2, "mid", "low"))
    rows = [(i, *map(float, r), float(v), str(c), str(c == "high")) for i, (r, v, c) in enumerate(zip(x, y, label, strict=True))]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, d double, y double, label string, two string").repartition(4), x, y, label


FEATURES = ["a", "b", "c", "d"]


def keys_of(spark, df):
    return dict(df.selectExpr("key", "xxhash64(key) as h").collect())


def forest(spark, kind, classify, trees, **more):
    df, x, y, label = made(spark)
    model = getattr(M, kind)(df, "key", FEATURES, "label" if classify else "y", classify, depth=4, **({} if kind == "decision_tree" else {"trees": trees, "seed": 5}), **more)
    classes = sorted(set(label))
    s = np.ones((len(y), 4 if classify else 2))
    s[:, 1:] = (label[:, None] == np.array(classes)) if classify else y[:, None]
    subset = 2 if classify and kind != "decision_tree" else None
    spec = M.Spec(4, 2, more.get("min_leaf", 1), subset, kind == "random_forest", kind == "extra_trees", 5 if kind != "decision_tree" else 0)
    h = keys_of(spark, df)
    rows = np.array([h[i] for i in range(len(y))])
    total = 0
    for t in range(trees):
        w = M.draws(rows, t, 5)[:, None] if spec.bootstrap else 1
        tree = grown(x, s * w, s.shape[1] - 1, spec, t)
        total = total + np.array([leaf(tree, r)[1:] / leaf(tree, r)[0] for r in x])
    return df, model, total / trees, classes


@pytest.mark.parametrize(("kind", "trees"), [("decision_tree", 1), ("random_forest", 5), ("extra_trees", 5)])
@pytest.mark.parametrize("classify", [True, False])
def test_trees_equal_brute_force(spark, kind, trees, classify):
    df, model, want, classes = forest(spark, kind, classify, trees)
    got = {r.key: r for r in model.predict(df, "key").collect()}
    for i, v in enumerate(want):
        if classify:
            assert abs(got[i].share - v.max()) < 1e-9 and v[classes.index(got[i].prediction)] > v.max() - 1e-9
        else:
            assert abs(got[i].prediction - v[0]) < 1e-9
    shares = {r.feature: r.importance for r in model.importance(spark).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["d"] == 0 and shares["a"] > shares["d"]


@pytest.mark.parametrize("target", ["y", "two", "label"])
def test_boosting_equals_brute_force(spark, target):
    df, x, y, label = made(spark)
    values = {"y": y, "two": (label == "high").astype(float), "label": np.searchsorted(sorted(set(label)), label).astype(float)}[target]
    classify = target != "y"
    wide = 3 if target == "label" else 1
    model = M.gradient_boosting(df, "key", FEATURES, target, classify, trees=4, rate=0.3, depth=2, renew=2)
    if target == "y":
        scores = np.full((len(y), 1), y.mean())
    elif target == "two":
        scores = np.full((len(y), 1), np.log(values.mean() / (1 - values.mean())))
    else:
        scores = np.tile(np.log(np.bincount(values.astype(int)) / len(y)), (len(y), 1))
    for _ in range(4):
        now = scores.copy()
        for k in range(wide):
            if not classify:
                g, h = values - now[:, 0], np.ones(len(y))
            elif wide == 1:
                p = 1 / (1 + np.exp(-now[:, 0]))
                g, h = values - p, p * (1 - p)
            else:
                g = (values == k) - M._shares(now)[:, k]
                h = np.abs(g) * (1 - np.abs(g)) * 1.5
            tree = grown(x, np.column_stack([np.ones(len(y)), g, h]), 1, M.Spec(2))
            scores[:, k] += [0.3 * leaf(tree, r)[1] / leaf(tree, r)[2] for r in x]
    got = {r.key: r for r in model.predict(df, "key").collect()}
    for i in range(len(y)):
        want = M._shares(scores[i : i + 1])[0].max() if classify else scores[i, 0]
        assert abs((got[i].share if classify else got[i].prediction) - want) < 1e-9


def test_missing_values_few_rows_and_many_values(spark):
    rows = [(1, None, 1.0), (2, float("nan"), 2.0), (3, 1.0, 5.0), (4, 3.0, None), (5, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "key long, a double, y double")
    model = M.decision_tree(df, "key", ["a"], "y", False, depth=3)
    got = {r.key: r.prediction for r in model.predict(df, "key").collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 5.0, 4: 1.5, 5: 9.0}  # missing: the mean, 13/3
    many = spark.range(3000).selectExpr("id as key", "sin(id) as a", "if(sin(id) > 0.3, 10.0, 0.0) as y")
    model = M.decision_tree(many, "key", ["a"], "y", False, depth=2, bins=64)
    assert M.assess(model, many, "key", "y").first().r2 > 0.9
    twice = many.union(many.selectExpr("key", "a", "double(null) as y")).union(many)
    assert M.assess(model, twice, "key", "y").first().n == 6000
    one = M.decision_tree(df.where("key = 3"), "key", ["a"], "y", False)
    assert one.predict(df, "key").where("key = 1").first().prediction == 5.0


def test_rows_in_the_same_bins_are_one_row(spark):
    from tessella.operators import trees

    rows = [(i, float(i % 3), float(i % 2), float(i % 3 * 10 + i % 2 * 4 + i % 7), "ab"[i % 5 % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, u double, v double, y double, c string").repartition(5)
    binned, _, _ = trees._prepared(df, "key", ["u", "v"], "y", None, 255)
    assert binned.count() == 6 and binned.agg({"w": "sum"}).first()[0] == 600
    binned, _, _ = trees._prepared(df, "key", ["u", "v"], "c", ["a", "b"], 255)
    assert binned.count() == 12 and binned.agg({"w": "sum"}).first()[0] == 600
    assert trees._prepared(df, "key", ["u", "v"], "y", None, 255, True)[0].count() == 600  # draws go by row
    cells = {}
    for _, u, v, y, _ in rows:
        cells.setdefault((u, v), []).append(y)
    got = {r.key: r.prediction for r in trees.decision_tree(df, "key", ["u", "v"], "y", False, depth=4).predict(df, "key").collect()}
    assert all(abs(got[i] - sum(cells[u, v]) / len(cells[u, v])) < 1e-7 for i, u, v, _, _ in rows)


@pytest.mark.parametrize("name", ["gradient_boosting_classifier", "gradient_boosting_regressor"])
def test_boosting_queries_fit_the_whole_model(spark, monkeypatch, name):
    import __spark_entry__ as entry

    models = []
    leaf = (np.full(15, -1), np.zeros(15, int), np.zeros(15), {0: np.array([1.0, 0.0, 1.0])}, np.zeros(4), (3,))
    monkeypatch.setattr(M, "_grow", lambda blocks, bounds, trees, *_: [leaf for _ in trees])
    monkeypatch.setattr(M.Model, "predict", lambda self, rows, key: models.append(self) or rows)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert [(len(m.feature), m.rate, m.depth) for m in models] == [(100, 0.1, 3)]  # as the reference fits, not three trees of two levels
    assert "round < 100" in entry.oracle_sql()[name]


def test_histograms_of_several_partitions_meet(spark):
    df, *_ = made(spark)
    binned, _, bounds = M._prepared(df, "key", FEATURES, "y", None, 255, True)
    scored = binned.selectExpr("*", "array(0D) AS scores")
    found = []
    for n in (1, 5):
        blocks = M._blocks(scored.repartition(n))
        assert blocks.getNumPartitions() == n
        found.append(M._grow(blocks, bounds, range(2), M.Spec(3), 1, lambda y, scores, t: np.column_stack([np.ones(len(y)), y])))
    for (f, b, c, sums, gains, _), (g, e, d, other, more, _) in zip(*found, strict=True):
        assert (f == g).all() and (b == e).all() and (c == d).all() and (f >= 0).any()
        assert set(sums) == set(other) and all(np.allclose(sums[k], other[k]) for k in sums) and np.allclose(gains, more)

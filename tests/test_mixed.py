import itertools
import math

import numpy as np
import pytest

from tessella.operators.gene_sets import shuffled
from tessella.operators.mixed import linear_mixed_model
from tessella.operators.permutations import mantel, permanova
from tessella.sources.write import export_results


def by_matrices(x, y, g, ratio, reml):
    """Value of the profile likelihood and the fit, with the covariance written out."""
    v = np.eye(len(y)) + ratio * (g[:, None] == g[None, :])
    inv = np.linalg.inv(v)
    xx = x.T @ inv @ x
    beta = np.linalg.solve(xx, x.T @ inv @ y)
    rss = (y - x @ beta) @ inv @ (y - x @ beta)
    free = len(y) - (x.shape[1] if reml else 0)
    return np.linalg.slogdet(v)[1] + free * math.log(rss) + (np.linalg.slogdet(xx)[1] if reml else 0), beta, np.linalg.inv(xx) * rss / free, rss / free


@pytest.mark.parametrize("reml", [True, False])
def test_mixed_model(spark, reml):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 12, 48)
    a, b = rng.standard_normal(48) + 30, rng.integers(0, 3, 48)
    y = 2 + 0.5 * a + (b == 1) - 2.0 * (b == 2) + rng.standard_normal(12)[g] * 1.5 + rng.standard_normal(48)
    rows = [(f"g{i}", float(p), "xyz"[q], float(v)) for i, p, q, v in zip(g, a, b, y, strict=True)] + [("g1", None, "x", 1.0), (None, 1.0, "x", 1.0), ("g1", 1.0, "x", float("nan"))]
    df = spark.createDataFrame(rows, "g string, a double, b string, y double").repartition(4)
    got = {r.term: r for r in linear_mixed_model(df, "y", ["a", "b"], "g", ("b",), reml).collect()}
    x = np.column_stack([np.ones(48), a, b == 1, b == 2]).astype(float)
    lo, hi = -4.0, 4.0
    for _ in range(45):  # golden section
        p, q = hi - (hi - lo) * 0.6180339887498949, lo + (hi - lo) * 0.6180339887498949
        lo, hi = (lo, q) if by_matrices(x, y, g, math.exp(p), reml)[0] < by_matrices(x, y, g, math.exp(q), reml)[0] else (p, hi)
    best = math.exp((lo + hi) / 2)
    _, beta, cov, residual = by_matrices(x, y, g, best, reml)
    for k, term in enumerate(["intercept", "a", "b_y", "b_z"]):
        assert abs(got[term].estimate - beta[k]) < 1e-6 and abs(got[term].se - math.sqrt(cov[k, k])) < 1e-6
        assert abs(got[term].z - got[term].estimate / got[term].se) < 1e-9
    assert abs(got["group_var"].estimate / (best * residual) - 1) < 1e-5 and abs(got["residual_var"].estimate - residual) < 1e-6
    assert (got["n_groups"].estimate, got["n_obs"].estimate) == (12, 48)
    if not reml:
        return
    even = spark.createDataFrame([(i % 4, float(i // 4)) for i in range(40)], "g int, y double")
    assert {r.term: r.estimate for r in linear_mixed_model(even, "y", [], "g").collect()}["group_var"] == 0
    assert linear_mixed_model(df.limit(0), "y", ["a"], "g").first().estimate is None
    assert linear_mixed_model(df.withColumn("c", df.a), "y", ["a", "c"], "g").first().estimate is None


def table(spark, x):
    rows = [(f"s{i:02d}", f"s{j:02d}", float(np.linalg.norm(x[i] - x[j]))) for i, j in itertools.combinations(range(len(x)), 2)]
    return spark.createDataFrame([(b, a, d) if k % 3 == 0 else (a, b, d) for k, (a, b, d) in enumerate(rows)], "a string, b string, d double").repartition(4)


def test_permanova_and_mantel(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((18, 3))
    y = x + rng.standard_normal((18, 3))
    code = np.arange(18) % 3
    x[code == 1] += 0.7
    groups = spark.createDataFrame([(f"s{i:02d}", f"g{c}") for i, c in enumerate(code)] + [("none", "g0"), ("s00", "g0")], "s string, g string")
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)

    def f(c):
        total = d2.sum() / 2 / 18
        within = sum(d2[np.ix_(c == k, c == k)].sum() / 2 / (c == k).sum() for k in range(3))
        return (total - within) / 2 / (within / 15), 1 - within / total

    r = permanova(table(spark, x), groups, "s", "g", 50, 4).first()
    null = [f(code[shuffled(np.arange(18), 18, p, 4)])[0] for p in range(1, 51)]
    assert abs(r.f - f(code)[0]) < 1e-9 and abs(r.r2 - f(code)[1]) < 1e-9 and (r.n, r.n_groups) == (18, 3)
    assert abs(r.p - (1 + sum(v >= r.f - 1e-12 for v in null)) / 51) < 1e-12
    assert permanova(table(spark, x), groups.where("g = 'g1'"), "s", "g", 10).first().f is None
    e = ((y[:, None] - y[None]) ** 2).sum(axis=2) ** 0.5
    d, tri = d2**0.5, np.triu_indices(18, 1)
    r = mantel(table(spark, x), table(spark, y), 40, 2).first()
    null = []
    for p in range(1, 41):
        q = shuffled(np.arange(18), 18, p, 2)
        null.append(np.corrcoef(d[tri], e[np.ix_(q, q)][tri])[0, 1])
    assert abs(r.r - np.corrcoef(d[tri], e[tri])[0, 1]) < 1e-9 and abs(r.z - (d[tri] * e[tri]).mean()) < 1e-9
    assert abs(r.p - (1 + sum(v >= r.r - 1e-12 for v in null)) / 41) < 1e-12
    assert mantel(table(spark, x[:2]), table(spark, y), 10).first().r is None


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("c2", 5, 9, "x", None, 1.5), ("c1", 7, 8, None, 3, 2.5), ("c1", 2, 4, "y", 1, None), (None, 1, 2, "z", 1, 1.0)], "chrom string, start int, end int, name string, score int, value double")
    read = lambda p: [r.value for r in spark.read.text(p).collect()]
    path = export_results(df, f"file://{tmp_path}/bed", "bed")
    assert read(path) == ["c1\t2\t4\ty\t1", "c1\t7\t8\t.\t3", "c2\t5\t9\tx\t0"]
    assert read(export_results(df, f"file://{tmp_path}/bg", "bedgraph")) == ["c1\t2\t4\t.", "c1\t7\t8\t2.5", "c2\t5\t9\t1.5"]
    with pytest.raises(FileExistsError):
        export_results(df, path, "bed")
    assert export_results(df.where("chrom = 'c2'"), path, "bed", overwrite=True) == path and read(path) == ["c2\t5\t9\tx\t0"]
    seqs = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", ""), ("c", None)], "name string, sequence string").coalesce(1)
    assert read(export_results(seqs, f"file://{tmp_path}/fa", "fasta", width=4)) == [">a", "ACGT", "ACGT", "AC", ">b", ""]
    for kind in ("csv", "tsv", "parquet", "json"):
        p = export_results(df, f"file://{tmp_path}/{kind}", kind)
        back = spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(p) if kind in ("csv", "tsv") else spark.read.format(kind).load(p)
        assert back.count() == 4 and set(back.columns) == set(df.columns)
    with pytest.raises(ValueError, match="none of"):
        export_results(df, f"file://{tmp_path}/x", "xlsx")
    bad = spark.createDataFrame([("a",)], "v string").selectExpr("string(raise_error('no')) as v")
    with pytest.raises(Exception, match="no"):
        export_results(bad, f"file://{tmp_path}/bad", "csv")
    assert not list(tmp_path.glob("*.part")) and not (tmp_path / "bad").exists()

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.operators import ontology, phylogeny
from tessella.operators.pruning import ld_prune

EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("d", "b"), (None, "a")]


def above(term):
    seen, stack = set(), [term]
    while stack:
        t = stack.pop()
        if t not in seen:
            seen.add(t)
            stack += [p for c, p in EDGES if c == t]
    return seen


def test_closure_and_depths(spark):
    df = spark.createDataFrame(EDGES, "child string, parent string")
    got = [tuple(r) for r in ontology.closure(df, "child", "parent").collect()]
    want = {(t, a) for t in "abcdexyzws" for a in above(t)}
    assert len(got) == len(want) and set(got) == want
    depths = {r.term: (r.depth, r.n_parents) for r in ontology.depths(df, "child", "parent").collect()}
    assert depths["a"] == (0, 0) and depths["d"] == (2, 2) and depths["e"] == (3, 2) and depths["x"] == (None, 1) and depths["w"] == (None, 1)
    assert ontology.closure(df.limit(0), "child", "parent").count() == 0
    chain = spark.range(1, 10).selectExpr("id as child", "id - 1 as parent")
    assert ontology.closure(chain, "child", "parent").count() == 10 * 11 // 2
    assert ontology.depths(chain, "child", "parent").agg({"depth": "max"}).first()[0] == 9


def test_similarity(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string")
    notes = [("g1", "e"), ("g1", "b"), ("g2", "c"), ("g3", "d"), ("g4", "a"), ("g4", "q"), ("g5", None), (None, "b"), ("g1", "e")]
    genes = {g: {t for h, t in notes if h == g and t} for g, _ in notes if g}
    genes = {g: t for g, t in genes.items() if t}
    ups = {g: set().union(*[above(t) for t in ts]) for g, ts in genes.items()}
    ic = {t: -math.log2(sum(t in u for u in ups.values()) / len(genes)) for t in set().union(*ups.values())}
    df = spark.createDataFrame(notes, "gene string, go string")
    pairs = ontology.closure(edges, "child", "parent")
    got = ontology.information_content(df, pairs, "gene", "go")
    assert {r.term: round(r.ic, 9) for r in got.collect()} == {t: round(v, 9) for t, v in ic.items()}

    def resnik(s, t):
        return max([ic.get(a, 0.0) for a in above(s) & above(t)], default=0.0)

    asked = [(s, t) for s in "abcdexw" for t in "bdew"]
    rows = ontology.term_similarity(spark.createDataFrame(asked, "p string, q string"), pairs, got, "p", "q").collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert abs(r.resnik - resnik(r.p, r.q)) < 1e-12 and abs(r.jaccard - len(above(r.p) & above(r.q)) / len(above(r.p) | above(r.q))) < 1e-12
        both = ic.get(r.p, 0) + ic.get(r.q, 0)
        assert abs(r.lin - (2 * r.resnik / both if both > 0 else 0)) < 1e-12
    asked = [(g, h) for g in ("g1", "g2", "g3", "none") for h in ("g1", "g4")]
    known = {g: {t for t in ts if t != "q"} for g, ts in genes.items()}
    for r in ontology.gene_similarity(spark.createDataFrame(asked, "p string, q string"), df.where("go <> 'q' or go is null"), pairs, got, "gene", "go", "p", "q").collect():
        s, t = known.get(r.p, set()), known.get(r.q, set())
        m = [[resnik(i, j) for j in t] for i in s]
        want = (np.mean([max(v) for v in m]) + np.mean([max(v) for v in zip(*m, strict=True)])) / 2 if s and t else 0
        assert abs(r.best_match_average - want) < 1e-12 and r.shared_terms == (len(s & t) if s and t else 0)


@pytest.mark.parametrize("block", [128, 3])
def test_unifrac_and_faith(spark, block, monkeypatch):
    monkeypatch.setattr(phylogeny, "_SAMPLES", block)
    monkeypatch.setattr(phylogeny, "_NODES", 4)
    tree = [("r", None, None), ("u", "r", 0.5), ("v", "r", 1.5), ("t1", "u", 1.0), ("t2", "u", 2.0), ("t3", "v", 0.25), ("t4", "v", 3.0)]
    rnd = random.Random(4)
    cells = [(s, t, float(rnd.choice([0, 0, 1, 5]))) for s in "ABCDEFG" for t in ("t1", "t2", "t3", "t4")] + [("Z", "t1", 0.0), ("Y", "t2", None)]
    up = {"t1": "u", "t2": "u", "t3": "v", "t4": "v", "u": "r", "v": "r"}
    length = {n: v or 0 for n, _, v in tree}
    at = {}
    for s, t, c in cells:
        at.setdefault(s, {})
        node = t
        while node:
            at[s][node] = at[s].get(node, 0) + (c or 0)
            node = up.get(node)
    t = spark.createDataFrame(tree, "node string, parent string, length double")
    c = spark.createDataFrame(cells, "sample string, taxon string, count double")
    for r in phylogeny.faith_pd(c, t, "sample", "taxon", "count").collect():
        assert abs(r.pd - sum(length[n] for n, v in at[r.sample].items() if v > 0)) < 1e-12
        assert r.n_taxa_observed == sum((v or 0) > 0 for s, _, v in cells if s == r.sample)
    for weighted in (False, True):
        rows = phylogeny.unifrac(c, t, "sample", "taxon", "count", weighted).collect()
        assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in sorted(at) for b in sorted(at) if a < b]
        for r in rows:
            x, y = at[r.a], at[r.b]
            tx, ty = x.get("r", 0), y.get("r", 0)
            if weighted:
                want = sum(length[n] * abs((x.get(n, 0) / tx if tx else 0) - (y.get(n, 0) / ty if ty else 0)) for n in length)
            else:
                either = sum(length[n] for n in length if x.get(n, 0) > 0 or y.get(n, 0) > 0)
                one = sum(length[n] for n in length if (x.get(n, 0) > 0) != (y.get(n, 0) > 0))
                want = one / either if either else 0
            assert abs(r.distance - want) < 1e-12, (r, want)
    assert phylogeny.unifrac(c.limit(0), t, "sample", "taxon", "count").count() == 0
    with pytest.raises(Exception, match="no tip of the tree"):
        phylogeny.faith_pd(spark.createDataFrame([("A", "t9", 1.0)], "sample string, taxon string, count double"), t, "sample", "taxon", "count").collect()


@pytest.mark.parametrize("tree", [
    [("n0", None, 1.0), *[(f"n{k}", f"n{k - 1}", k / 8) for k in range(1, 9)], ("t", "n1", 0.25)],  # a chain with a tip beside
    [("r", None, 9.0), ("a", "r", 1.0), ("b", "r", 2.0), ("t", "a", 0.5), ("u", "t", None), ("v", "v", 4.0)],  # counts at nodes within, an edge to itself
    [("t", "a", 1.0), ("a", "b", 2.0), ("b", "c", 4.0), ("c", "a", 8.0), ("u", "c", 0.5)],  # a way that never ends
    [("t", "a", 1.0), ("t", "b", 1.0), ("a", "r", 2.0), ("b", "r", 4.0), ("u", "a", 0.5)],  # two ways up
])
@pytest.mark.parametrize("unsure", [1, 2, 64])
def test_sums_go_up_any_tree(spark, tree, unsure):
    if unsure == 64 and ("c", "a", 8.0) in tree:
        unsure = 5
    up, nodes = {}, sorted({n for n, _, _ in tree} | {p for _, p, _ in tree if p})
    for n, p, _ in tree:
        up.setdefault(n, set()).add(p)
    tips = [(s, n, float(1 + (i + k) % 3)) for k, s in enumerate("AB") for i, n in enumerate(nodes) if (i + k) % 2]
    want = {}
    for s, n, c in tips:
        seen, front = set(), {n}
        while front:
            seen |= front
            front = {p for x in front for p in up.get(x, ()) if p} - seen
        for x in seen:
            want[s, x] = want.get((s, x), 0) + c
    t = spark.createDataFrame(tree, "node string, parent string, length double")
    got = phylogeny._above(spark.createDataFrame(tips, "sample string, node string, count double"), t, unsure).distinct().collect()
    assert {(r.sample, r.node): r["count"] for r in got} == want and len(got) == len(want)
    assert {r.node: r.length for r in got}.items() <= {x: next((v or 0.0 for n, p, v in tree if n == x and p), 0.0) for x in nodes}.items()


def test_diversity_on_a_tree_reads_its_cells_once(spark):
    t = spark.createDataFrame([("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 2.0)], "node string, parent string, length double")
    cells = [("A", "a", 1.0), ("A", "b", None), ("B", "a", 2.0), ("B", "b", 2.0), ("C", "b", float("nan"))]
    for of, want in ((phylogeny.faith_pd, [("A", 1.0, 1), ("B", 3.0, 2), ("C", 0.0, 0)]), (phylogeny.unifrac, [("A", "B", 2 / 3), ("A", "C", 1.0), ("B", "C", 1.0)])):
        read = spark.sparkContext.accumulator(0)
        c = spark.createDataFrame(spark.sparkContext.parallelize(cells, 2).map(lambda r, read=read: (read.add(1), r)[1]), "sample string, taxon string, count double")
        assert sorted(tuple(r) for r in of(c, t, "sample", "taxon", "count").collect()) == want
        assert read.value == len(cells)


@pytest.mark.parametrize(("window", "block", "chunk"), [(5, 4096, 4096), (5, 7, 3), (70, 16, 8)])
def test_ld_prune(spark, window, block, chunk):
    rng = np.random.default_rng(6)
    x = np.zeros((200, 24))
    for v in range(200):
        x[v] = rng.integers(0, 3, 24) if v % 9 == 0 or rng.random() < 0.2 else np.where(rng.random(24) < 0.2, rng.integers(0, 3, 24), x[v - 1])
    x[50], x[rng.random(x.shape) < 0.1] = 1, np.nan
    keep = [True] * 200
    for i in range(200):
        for j in range(i + 1, min(i + window + 1, 200)):
            ok = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if keep[i] and keep[j] and ok.sum() >= 3 and x[i, ok].std() > 1e-12 and x[j, ok].std() > 1e-12 and np.corrcoef(x[i, ok], x[j, ok])[0, 1] ** 2 > 0.2:
                keep[j] = False
    cells = [(v * 3 + 7, s, None if np.isnan(x[v, s]) else float(x[v, s])) for v in range(200) for s in range(24)]
    df = spark.createDataFrame(cells, "variant long, sample long, dosage double").repartition(5)
    got = {r.variant: r.kept for r in ld_prune(df, "variant", "sample", "dosage", window, 0.2, chunk, block).collect()}
    assert got == {v * 3 + 7: k for v, k in enumerate(keep)} and not all(keep)
    assert ld_prune(df.limit(0), "variant", "sample", "dosage").count() == 0


def test_ld_prune_rounds_do_not_grow_with_the_blocks(spark, monkeypatch):
    from tessella.operators import pruning

    writes, write = [], pruning.materialized
    monkeypatch.setattr(pruning, "materialized", lambda df: writes.append(1) or write(df))
    x = np.random.default_rng(3).integers(0, 3, (1920, 7))
    linked = lambda i, j: x[i].std() > 0 and x[j].std() > 0 and np.corrcoef(x[i], x[j])[0, 1] ** 2 > 0.05
    keep = []
    for j in range(1920):
        keep.append(not any(keep[i] and linked(i, j) for i in range(max(0, j - 10), j)))
    cells = [(v, s, float(x[v, s])) for v in range(1920) for s in range(7)]
    df = spark.createDataFrame(cells, "variant long, sample long, dosage double").repartition(2)
    got = {r.variant: r.kept for r in ld_prune(df, "variant", "sample", "dosage", 10, 0.05, block=160).collect()}
    assert got == dict(enumerate(keep)) and len(writes) <= 8, len(writes)
    same = spark.createDataFrame([(v, s, float(s)) for v in range(30) for s in range(3)], "variant long, sample long, dosage double")  # no block agrees by chance
    got = {r.variant: r.kept for r in ld_prune(same, "variant", "sample", "dosage", 4, 0.2, block=7).collect()}
    assert got == {v: v % 5 == 0 for v in range(30)}


def test_hot_genes_unknown_terms_and_one_pass(spark):
    from tessella.operators import ontology

    pairs = ontology.closure(spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 5)], "c long, p long"), "c", "p")
    notes = spark.createDataFrame([(1, 4), (1, 4), (1, 2), (1, 3), (2, 9), (2, 4), (None, 4), (3, None)], "g long, t long")
    want = {(1, 4), (1, 3), (1, 2), (1, 1), (2, 9), (2, 4), (2, 3), (2, 2), (2, 1)}
    for limits in ({}, {"hot": 2}, {"each": 1}):
        got = [tuple(r) for r in ontology.expand(notes, pairs, "g", "t", **limits).collect()]
        assert len(got) == len(want) and set(got) == want
    plan = ontology.expand(notes, pairs, "g", "t").groupBy("t").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gene" in plan and "hashpartitioning(gene#" in plan and ", term#" not in "".join(x for x in plan.splitlines() if "hashpartitioning(gene" in x)  # pairs are never shuffled by gene and term
    ic = spark.createDataFrame([(1, 0.0), (4, 1.0), (2, 0.5), (9, 2.0)], "term long, ic double")
    got = {(r.a, r.b): tuple(r)[2:] for r in ontology.term_similarity(spark.createDataFrame([(4, 2), (9, 4), (5, 4), (4, 4), (8, 8)], "a long, b long"), pairs, ic, "a", "b").collect()}
    assert got == {(4, 2): (0.5, 2 / 3, 0.5, 1.0, 0.5), (9, 4): (0.0, 0.0, 0.0, 2.0, 1.0), (5, 4): (0.0, 0.0, 0.0, 0.0, 1.0), (4, 4): (1.0, 1.0, 1.0, 1.0, 1.0), (8, 8): (0.0, 0.0, 0.0, 0.0, 0.0)}


def test_hypergeometric_tail_of_large_counts(spark):
    import math

    from tessella.functions.distributions import hypergeometric_sf

    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    rows = [(k, 3000, m, d) for m, d in ((700, 600), (2900, 600), (5, 600), (3000, 3000), (0, 10)) for k in (0, 1, 3, 139, 140, 141, 180, 590, 601, 3000)]
    df = spark.createDataFrame(rows, "k long, n long, m long, d long")
    for r in df.withColumn("p", hypergeometric_sf(*(F.col(c) for c in "knmd"))).collect():
        want = min(1.0, math.fsum(math.exp(choose(r.m, i) + choose(r.n - r.m, r.d - i) - choose(r.n, r.d)) for i in range(max(r.k, r.d - (r.n - r.m), 0), min(r.m, r.d) + 1)))
        assert math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-300), (r, want)

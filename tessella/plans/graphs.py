"""Queries over hazards, ontologies, trees of taxa and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import ontology, phylogeny
from tessella.operators.cox import cox_regression
from tessella.operators.enrichment import enrich
from tessella.operators.pruning import ld_prune
from tessella.plans.core import rounded
from tessella.plans.fixtures import table
from tessella.plans.tails import choose, normal_two_sided

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql, places=6):
    def add(f):
        QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
        SQL[name] = sql
        return f

    return add


# --- hazards: days to shipping, returned or not, by quantity and discount

_LV = "lv AS (SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))::DOUBLE AS t, l_returnflag = 'R' AS e, l_quantity / 50.0::DOUBLE AS x, l_discount * 10.0::DOUBLE AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _hazards(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.abs(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("time"), (F.col("l_returnflag") == "R").cast("int").alias("event"), (F.col("l_quantity") / 50.0).alias("quantity"), (F.col("l_discount") * 10.0).alias("discount"))


def _cox_sql(rounds: int = 7) -> str:
    """Newton's steps from zero, each written out; two covariates."""
    out = [_LV, "lw AS MATERIALIZED (SELECT * FROM lv WHERE t > 0)", "b0 AS (SELECT 0.0::DOUBLE AS bx, 0.0::DOUBLE AS bz)"]
    sums = {"0": "r", "1": "r * x", "2": "r * z", "11": "r * x * x", "12": "r * x * z", "22": "r * z * z"}
    for k in range(rounds):
        each = ", ".join(f"sum({v}) AS s{c}, sum({v}) FILTER (e) AS d{c}" for c, v in sums.items())
        out.append(f"e{k} AS (SELECT t, count(*) FILTER (e) AS d, sum(x) FILTER (e) AS dx, sum(z) FILTER (e) AS dz, {each} FROM (SELECT lw.*, bx, bz, exp(bx * x + bz * z) AS r FROM lw, b{k}) GROUP BY t)")
        out.append(f"c{k} AS (SELECT d, dx, dz, {', '.join(f'd{c}, sum(s{c}) OVER (ORDER BY t DESC) AS s{c}' for c in sums)} FROM e{k})")
        out.append(f"l{k} AS (SELECT *, s0 - f * d0 AS den, (s1 - f * d1) / (s0 - f * d0) AS m1, (s2 - f * d2) / (s0 - f * d0) AS m2 FROM (SELECT *, unnest(range(d)) / d::DOUBLE AS f FROM c{k} WHERE d > 0))")
        out.append(f"n{k} AS (SELECT sum(dx / d - m1) AS u1, sum(dz / d - m2) AS u2, sum((s11 - f * d11) / den - m1 * m1) AS i11, sum((s12 - f * d12) / den - m1 * m2) AS i12, sum((s22 - f * d22) / den - m2 * m2) AS i22, sum((bx * dx + bz * dz) / d - ln(den)) AS ll FROM l{k}, b{k})")
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT bx + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) AS bx, bz + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) AS bz FROM n{k}, b{k})")
    k = rounds - 1
    out.append(f"q AS (SELECT 'quantity' AS covariate, bx AS coef, sqrt(i22 / (i11 * i22 - i12 * i12)) AS se, ll FROM n{k}, b{k} UNION ALL SELECT 'discount', bz, sqrt(i11 / (i11 * i22 - i12 * i12)), ll FROM n{k}, b{k})")
    return f"WITH {', '.join(out)} SELECT covariate, round(coef, 6) AS coef, round(exp(coef), 6) AS hr, round(se, 6) AS se, round(coef / se, 6) AS z, round({normal_two_sided('coef / se')}, 6) AS p, round(exp(coef - 1.959963984540054 * se), 6) AS ci_low, round(exp(coef + 1.959963984540054 * se), 6) AS ci_high, (SELECT count(*) FROM lw) AS n, (SELECT count(*) FROM lw WHERE e) AS events, round(ll, 4) AS log_likelihood, round(4 - 2 * ll, 4) AS aic FROM q"


@query("cox_regression", _cox_sql())
def _(spark, d):
    return cox_regression(_hazards(spark, d), "time", "event", ["quantity", "discount"]).withColumns({c: F.round(c, 4) for c in ("log_likelihood", "aic")})


# --- an ontology: every part is a term below the parts numbered a quarter and a tenth of it; customers are the genes

_EDGES = "edges AS (SELECT DISTINCT p_partkey AS term, unnest([p_partkey // 4, p_partkey // 10]) AS parent FROM part WHERE p_partkey > 0)"
_CLOSED = _EDGES + ", pairs AS (SELECT term, term AS ancestor FROM edges UNION SELECT parent, parent FROM edges UNION SELECT p.term, e.parent FROM pairs p JOIN edges e ON p.ancestor = e.term)"
_NOTES = "notes AS (SELECT DISTINCT o_custkey AS gene, l_partkey AS term FROM lineitem JOIN orders ON l_orderkey = o_orderkey), full_notes AS (SELECT DISTINCT gene, ancestor AS term FROM notes JOIN pairs USING (term))"
_IC = "ic AS (SELECT term, count(*) AS n_genes, -log2(count(*) / (SELECT count(DISTINCT gene) FROM notes)::DOUBLE) AS ic FROM full_notes GROUP BY 1)"


def _edges(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").where(p > 0).select(p.alias("term"), F.explode(F.array(F.floor(p / 4), F.floor(p / 10))).alias("parent"))


def _notes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("gene"), F.col("l_partkey").alias("term"))


@query("go_closure", f"WITH RECURSIVE {_CLOSED} SELECT term, ancestor FROM pairs")
def _(spark, d):
    return ontology.closure(_edges(spark, d), "term", "parent")


@query(
    "go_ic_profile",
    f"WITH RECURSIVE {_CLOSED}, {_NOTES}, {_IC}, walk AS (SELECT term, parent, 1 AS n FROM edges UNION SELECT w.term, e.parent, n + 1 FROM walk w JOIN edges e ON w.parent = e.term AND e.term <> e.parent), deep AS (SELECT term, max(n) AS depth FROM walk WHERE term <> 0 GROUP BY 1), par AS (SELECT term, count(*) AS n_parents FROM edges GROUP BY 1) "
    "SELECT t.term, round(coalesce(ic, 0), 6) AS ic, coalesce(n_genes, 0) AS n_genes, coalesce(depth, 0) AS depth, coalesce(n_parents, 0) AS n_parents FROM (SELECT DISTINCT ancestor AS term FROM pairs) t LEFT JOIN ic USING (term) LEFT JOIN deep USING (term) LEFT JOIN par USING (term)",
)
def _(spark, d):
    edges = _edges(spark, d)
    ic = ontology.information_content(_notes(spark, d), ontology.closure(edges, "term", "parent"), "gene", "term")
    return ontology.depths(edges, "term", "parent").join(ic, "term", "left").na.fill(0).select("term", "ic", "n_genes", "depth", "n_parents")


_ASKED = "asked AS (SELECT DISTINCT l_partkey AS a, (l_partkey * 7 + l_linenumber) % (SELECT max(p_partkey) FROM part) + 1 AS b FROM lineitem)"


@query(
    "go_term_similarity",
    f"WITH RECURSIVE {_CLOSED}, {_NOTES}, {_IC}, {_ASKED}, n AS (SELECT term, count(*) AS n FROM pairs GROUP BY 1), s AS (SELECT a, b, count(*) AS n, max(coalesce(ic, 0)) AS resnik FROM asked JOIN pairs p ON a = p.term JOIN pairs q ON b = q.term AND p.ancestor = q.ancestor LEFT JOIN ic ON ic.term = p.ancestor GROUP BY 1, 2), "
    "r AS (SELECT a, b, coalesce(resnik, 0) AS resnik, coalesce(s.n, 0) AS shared, coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(s.n, 0) AS either, coalesce(ia.ic, 0) AS ic_a, coalesce(ib.ic, 0) AS ic_b FROM asked LEFT JOIN s USING (a, b) LEFT JOIN n na ON na.term = a LEFT JOIN n nb ON nb.term = b LEFT JOIN ic ia ON ia.term = a LEFT JOIN ic ib ON ib.term = b) "
    "SELECT a, b, round(resnik, 6) AS resnik, round(CASE WHEN ic_a + ic_b > 0 THEN 2 * resnik / (ic_a + ic_b) ELSE 0 END, 6) AS lin, CASE WHEN either > 0 THEN shared / either::DOUBLE ELSE 0 END AS jaccard, round(ic_a, 6) AS ic_a, round(ic_b, 6) AS ic_b FROM r",
)
def _(spark, d):
    pairs = ontology.closure(_edges(spark, d), "term", "parent")
    ic = ontology.information_content(_notes(spark, d), pairs, "gene", "term")
    top = table(spark, d, "part").agg(F.max("p_partkey").alias("top"))
    asked = table(spark, d, "lineitem").crossJoin(F.broadcast(top)).select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % F.col("top") + 1).alias("b"))  # one row
    return ontology.term_similarity(asked, pairs, ic, "a", "b")


QUERIES["go_term_similarity"] = (lambda f: lambda spark, d: rounded(f(spark, d), "resnik", "lin", "ic_a", "ic_b"))(_)  # jaccard is a ratio of counts: not rounded


@query(
    "go_gene_similarity",
    f"WITH RECURSIVE {_CLOSED}, {_NOTES}, {_IC}, asked AS (SELECT DISTINCT n_nationkey + 1 AS a, n_nationkey + 2 AS b FROM nation), x AS (SELECT a, b, m.term AS ta, n.term AS tb FROM asked JOIN notes m ON m.gene = a JOIN notes n ON n.gene = b), tt AS (SELECT DISTINCT ta, tb FROM x), "
    "s AS (SELECT ta, tb, max(coalesce(ic, 0)) AS resnik FROM tt JOIN pairs p ON ta = p.term JOIN pairs q ON tb = q.term AND p.ancestor = q.ancestor LEFT JOIN ic ON ic.term = p.ancestor GROUP BY 1, 2), y AS (SELECT a, b, x.ta, x.tb, coalesce(resnik, 0) AS r FROM x LEFT JOIN s ON x.ta = s.ta AND x.tb = s.tb), "
    "l AS (SELECT a, b, avg(m) AS m, max(m) AS top FROM (SELECT a, b, ta, max(r) AS m FROM y GROUP BY ALL) GROUP BY ALL), k AS (SELECT a, b, avg(m) AS m FROM (SELECT a, b, tb, max(r) AS m FROM y GROUP BY ALL) GROUP BY ALL), c AS (SELECT a, b, count(*) FILTER (ta = tb) AS n FROM y GROUP BY ALL) "
    "SELECT a, b, round(coalesce((l.m + k.m) / 2, 0), 6) AS best_match_average, round(coalesce(top, 0), 6) AS max_similarity, coalesce(n, 0) AS shared_terms FROM asked LEFT JOIN l USING (a, b) LEFT JOIN k USING (a, b) LEFT JOIN c USING (a, b)",
)
def _(spark, d):
    notes, pairs = _notes(spark, d), ontology.closure(_edges(spark, d), "term", "parent")
    ic = ontology.information_content(notes, pairs, "gene", "term")
    asked = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("a"), (F.col("n_nationkey") + 2).alias("b"))
    return ontology.gene_similarity(asked, notes, pairs, ic, "gene", "term", "a", "b")


@query(
    "enrich_go",
    f"WITH RECURSIVE {_CLOSED}, {_NOTES}, hit AS (SELECT DISTINCT gene FROM notes JOIN customer ON gene = c_custkey WHERE c_mktsegment = 'BUILDING'), c AS (SELECT term, count(*) AS size, count(hit.gene) AS hits FROM full_notes LEFT JOIN hit USING (gene) GROUP BY 1), g AS (SELECT c.*, (SELECT count(*) FROM hit) AS drawn, (SELECT count(DISTINCT gene) FROM notes) AS total FROM c WHERE size >= 5), "
    f"p AS (SELECT *, least(list_sum(list_transform(range(hits, least(size, drawn) + 1), lambda i: exp({choose('size', 'i')} + {choose('total - size', 'drawn - i')} - {choose('total', 'drawn')}))), 1) AS p FROM (SELECT * FROM g)), r AS (SELECT *, count(*) OVER () * p / row_number() OVER (ORDER BY p) AS v, row_number() OVER (ORDER BY p) AS k FROM p) "
    "SELECT term, hits, size, drawn, total, round(drawn * size / total::DOUBLE, 6) AS expected, round(p, 6) AS p, round(least(min(v) OVER (ORDER BY k DESC), 1), 6) AS q FROM r",
)
def _(spark, d):
    notes = _notes(spark, d)
    full = ontology.expand(notes, ontology.closure(_edges(spark, d), "term", "parent"), "gene", "term")
    hits = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("gene"))
    out = enrich(hits, full, "gene", "term", min_size=5, genes=notes.dropna())
    q = next(c for c in out.columns if c not in ("term", "hits", "size", "drawn", "total", "fold", "p"))
    return out.select("term", "hits", "size", "drawn", "total", (F.col("drawn") * F.col("size") / F.col("total")).alias("expected"), "p", F.col(q).alias("q"))


# --- a tree of parts: node (level, number) stands for level * 10^10 + number, eight children a node, one root at level 8

_TREE = "tree AS (SELECT DISTINCT l * 10000000000 + p_partkey // 8 ** l::BIGINT AS node, (l + 1) * 10000000000 + p_partkey // (8 ** (l + 1))::BIGINT AS parent FROM part, (SELECT unnest(range(8)) AS l)), len AS (SELECT node, parent, (node % 7 + 1) / 4.0::DOUBLE AS length FROM tree)"
_UP = "up AS (SELECT node AS tip, node FROM len WHERE node < 10000000000 UNION ALL SELECT tip, parent FROM up JOIN len USING (node))"
_ABUND = "ab AS (SELECT c_nationkey AS sample, l_partkey AS tip, count(*)::DOUBLE AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_partkey % 3 = c_nationkey % 3 GROUP BY 1, 2)"
_BY = f"{_TREE}, {_UP}, {_ABUND}, by_node AS (SELECT sample, node, sum(c) AS c, coalesce(any_value(length), 0) AS length FROM ab JOIN up USING (tip) LEFT JOIN len USING (node) GROUP BY 1, 2)".replace("8 ** l::BIGINT", "(8 ** l)::BIGINT")


def _taxa(spark, d):
    p, level = F.col("p_partkey"), F.col("l")
    at = lambda k: (k * F.lit(10_000_000_000) + F.floor(p / F.pow(F.lit(8.0), k))).cast("long")
    tree = table(spark, d, "part").withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(at(level).alias("node"), at(level + 1).alias("parent")).distinct()
    tree = tree.withColumn("length", (F.col("node") % 7 + 1) / 4)
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_partkey") % 3 == F.col("c_nationkey") % 3)
    return li.groupBy(F.col("c_nationkey").alias("sample"), F.col("l_partkey").cast("long").alias("taxon")).agg(F.count(F.lit(1)).alias("count")), tree


@query("faith_pd", f"WITH RECURSIVE {_BY}, n AS (SELECT sample, count(*) AS n FROM ab GROUP BY 1) SELECT sample, round(sum(length), 6) AS pd, any_value(n) AS n_taxa_observed FROM by_node JOIN n USING (sample) GROUP BY 1")
def _(spark, d):
    return phylogeny.faith_pd(*_taxa(spark, d), "sample", "taxon", "count")


@query("unweighted_unifrac", f"WITH RECURSIVE {_BY}, pd AS (SELECT sample, sum(length) AS pd FROM by_node GROUP BY 1), sh AS (SELECT x.sample AS a, y.sample AS b, sum(x.length) AS s FROM by_node x JOIN by_node y ON x.node = y.node AND x.sample < y.sample GROUP BY 1, 2) SELECT p.sample AS a, q.sample AS b, round((p.pd + q.pd - 2 * coalesce(s, 0)) / (p.pd + q.pd - coalesce(s, 0)), 6) AS distance FROM pd p JOIN pd q ON p.sample < q.sample LEFT JOIN sh ON a = p.sample AND b = q.sample")
def _(spark, d):
    return phylogeny.unifrac(*_taxa(spark, d), "sample", "taxon", "count")


@query(
    "weighted_unifrac",
    f"WITH RECURSIVE {_BY}, tot AS (SELECT sample, sum(c) AS total FROM ab GROUP BY 1), pr AS (SELECT sample, node, length, c / total AS p FROM by_node JOIN tot USING (sample)), w AS (SELECT sample, sum(length * p) AS w FROM pr GROUP BY 1), sh AS (SELECT x.sample AS a, y.sample AS b, sum(x.length * least(x.p, y.p)) AS s FROM pr x JOIN pr y ON x.node = y.node AND x.sample < y.sample GROUP BY 1, 2) "
    "SELECT p.sample AS a, q.sample AS b, round(p.w + q.w - 2 * coalesce(s, 0), 6) AS distance FROM w p JOIN w q ON p.sample < q.sample LEFT JOIN sh ON a = p.sample AND b = q.sample",
)
def _(spark, d):
    return phylogeny.unifrac(*_taxa(spark, d), "sample", "taxon", "count", weighted=True)


# --- linkage: every part is a variant, a hundred samples of customers

_CALLS = "calls AS (SELECT l_partkey AS v, o_custkey % 100 AS s, sum(l_linenumber) % 3 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(
    "ld_prune",
    f"WITH RECURSIVE {_CALLS}, pos AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pl FROM (SELECT DISTINCT v FROM calls)), c AS (SELECT pl, s, d::DOUBLE AS d FROM calls JOIN pos USING (v)), "
    "e AS (SELECT a.pl AS i, b.pl AS j FROM c a JOIN c b ON a.s = b.s AND b.pl > a.pl AND b.pl <= a.pl + 20 GROUP BY 1, 2 HAVING count(*) >= 3 AND var_pop(a.d) > 1e-24 AND var_pop(b.d) > 1e-24 AND corr(a.d, b.d) ** 2 > 0.2003), "
    "prev AS MATERIALIZED (SELECT pl, coalesce(list(i) FILTER (i IS NOT NULL), []) AS before FROM pos LEFT JOIN e ON j = pl GROUP BY 1), "
    "walk AS (SELECT -1::BIGINT AS pl, []::BIGINT[] AS kept UNION ALL SELECT p.pl, CASE WHEN len(list_intersect(p.before, kept)) = 0 THEN list_append(list_filter(kept, lambda k: k > p.pl - 20), p.pl) ELSE list_filter(kept, lambda k: k > p.pl - 20) END FROM walk w JOIN prev p ON p.pl = w.pl + 1) "
    "SELECT v AS variant, list_contains(kept, pl) AS kept FROM walk JOIN pos USING (pl)",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    calls = li.groupBy(F.col("l_partkey").alias("variant"), (F.col("o_custkey") % 100).alias("sample")).agg((F.sum("l_linenumber") % 3).alias("dosage"))
    return ld_prune(calls, "variant", "sample", "dosage", 20, 0.2003)

"""Queries over the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import agreement as G
from tessella.operators import contingency as C
from tessella.operators import curves as R
from tessella.operators import ecology as E
from tessella.operators import genetics as N
from tessella.operators import groups as M
from tessella.operators import pvalues as V
from tessella.operators import sequence as Q
from tessella.operators import series as T
from tessella.operators import survival as L
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, DNA, DOSAGES, LIVES, PVALUES, SCORED, cells, dna, dosages, lives, pvalues, scored, table
from tessella.plans.tails import chi2_sf, f_sf, normal_two_sided, t_two_sided

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None, places=6):
    def add(f):
        def run(spark, d):
            df = f(spark, d)
            return rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


# p-values
_ADJUST = {
    "bh_adjust": ("bh", "round(least(min(p * n / k) OVER (ORDER BY k DESC), 1), 9)"),
    "by_adjust": ("by", "round(least(min(p * n * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) + 1 FROM pv)) t(i)) / k) OVER (ORDER BY k DESC), 1), 9)"),
    "holm_adjust": ("holm", "round(least(max(p * (n - k + 1)) OVER (ORDER BY k), 1), 9)"),
    "bonferroni": ("bonferroni", "round(least(p * n, 1), 9)"),
}
for _name, (_method, _sql) in _ADJUST.items():
    query(_name, f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS n FROM pv) SELECT key, round(p, 9) AS p, {_sql} AS q FROM r", 9)(lambda spark, d, m=_method: V.adjust(pvalues(spark, d), "p", "key", m))

query("storey_qvalue", f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS n FROM pv), z AS (SELECT least(1.0, count(*) FILTER (p > 0.5) / (0.5 * count(*))) AS z FROM pv) SELECT key, round(p, 9) AS p, round(least(least(min(p * n / k) OVER (ORDER BY k DESC), 1) * z, 1), 9) AS q FROM r, z", 9)(lambda spark, d: V.storey(pvalues(spark, d), "p", "key"))
query("correction", f"WITH {PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS n FROM pv), q AS (SELECT key, p, least(min(p * n / k) OVER (ORDER BY k DESC), 1) AS q FROM r) SELECT key, round(p, 9) AS p, round(q, 9) AS \"Q_VALUE\", q <= 0.05 AS \"SIGNIFICANT\" FROM q", 9)(lambda spark, d: V.correction(pvalues(spark, d), "p", "key", "fdr"))

# contingency
_LS = "t AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT r, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT r FROM t) CROSS JOIN (SELECT DISTINCT c FROM t) LEFT JOIN t USING (r, c)), e AS (SELECT *, sum(n) OVER (PARTITION BY r)::DOUBLE AS nr, sum(n) OVER (PARTITION BY c)::DOUBLE AS nc, sum(n) OVER ()::DOUBLE AS total FROM g), x AS (SELECT *, nr * nc / total AS e FROM e)"
query("chi_square", f"WITH {_LS}, s AS (SELECT sum((n - e) ** 2 / e) AS chi2, 2 * sum(CASE WHEN n > 0 THEN n * ln(n / e) ELSE 0 END) AS g, sum(n) AS n, count(DISTINCT r) AS a, count(DISTINCT c) AS b FROM x) SELECT round(chi2, 6) AS chi2, round(g, 6) AS g, (a - 1) * (b - 1) AS df, round({chi2_sf("chi2", "(a - 1) * (b - 1)")}, 6) AS p, round({chi2_sf("g", "(a - 1) * (b - 1)")}, 6) AS p_g, round(sqrt(chi2 / (n * (least(a, b) - 1))), 6) AS cramer_v, round(sqrt(chi2 / n), 6) AS phi, round(sqrt(chi2 / (chi2 + n)), 6) AS contingency, CAST(n AS BIGINT) AS n FROM s")(lambda spark, d: C.association(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))
query("theil_u", f"WITH {_LS}, h AS (SELECT (SELECT sum(-(nr / total) * ln(nr / total)) FROM (SELECT DISTINCT r, nr, total FROM x)) AS hr, (SELECT sum(-(nc / total) * ln(nc / total)) FROM (SELECT DISTINCT c, nc, total FROM x)) AS hc, (SELECT sum(CASE WHEN n > 0 THEN -(n / total) * ln(n / total) ELSE 0 END) FROM x) AS h) SELECT round(hr, 6) AS h_row, round(hc, 6) AS h_col, round(h, 6) AS h_joint, round((hr + hc - h) / hr, 6) AS u_row, round((hr + hc - h) / hc, 6) AS u_col, round(2 * (hr + hc - h) / (hr + hc), 6) AS u_symmetric FROM h")(lambda spark, d: C.theil_u(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))
_TWO = "t AS (SELECT count(*) FILTER (x AND y)::DOUBLE AS a, count(*) FILTER (x AND NOT y)::DOUBLE AS b, count(*) FILTER (NOT x AND y)::DOUBLE AS c, count(*) FILTER (NOT x AND NOT y)::DOUBLE AS d FROM (SELECT quality = 1 AS x, toxic = 1 AS y FROM labels))"


def _two(spark, d):
    return C.two_by_two(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


_Z = "1.959963984540054"
query("odds_ratio", f"WITH {_TWO}, h AS (SELECT a + 0.5 AS a, b + 0.5 AS b, c + 0.5 AS c, d + 0.5 AS d FROM t), s AS (SELECT a * d / (b * c) AS o, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM h) SELECT round(o, 6) AS odds_ratio, round(exp(ln(o) - {_Z} * se), 6) AS low, round(exp(ln(o) + {_Z} * se), 6) AS high, round(se, 6) AS se FROM s")(lambda spark, d: C.odds_ratio(_two(spark, d)))
query("risk_ratio", f"WITH {_TWO}, h AS (SELECT a + 0.5 AS a, b + 0.5 AS b, c + 0.5 AS c, d + 0.5 AS d FROM t), s AS (SELECT a / (a + b) AS p, c / (c + d) AS q, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS se FROM h) SELECT round(p / q, 6) AS risk_ratio, round(exp(ln(p / q) - {_Z} * se), 6) AS low, round(exp(ln(p / q) + {_Z} * se), 6) AS high, round(p - q, 6) AS risk_difference FROM s")(lambda spark, d: C.risk_ratio(_two(spark, d)))
query("cohens_h", f"WITH {_TWO} SELECT round(2 * asin(sqrt(a / (a + b))) - 2 * asin(sqrt(c / (c + d))), 6) AS h FROM t")(lambda spark, d: C.cohens_h(_two(spark, d)))
query("mcnemar", f"WITH {_TWO} SELECT CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, round((b - c) ** 2 / (b + c), 6) AS statistic, round(greatest(abs(b - c) - 1, 0) ** 2 / (b + c), 6) AS corrected, round({chi2_sf("(b - c) ** 2 / (b + c)", "1")}, 6) AS p, round({chi2_sf("greatest(abs(b - c) - 1, 0) ** 2 / (b + c)", "1")}, 6) AS p_corrected FROM t")(lambda spark, d: C.mcnemar(_two(spark, d)))
_RATERS = "t AS (SELECT quality AS r, toxic AS c, count(*) AS n FROM labels GROUP BY 1, 2), g AS (SELECT r, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT r FROM t) CROSS JOIN (SELECT DISTINCT c FROM t) LEFT JOIN t USING (r, c)), e AS (SELECT *, sum(n) OVER (PARTITION BY r)::DOUBLE AS nr, sum(n) OVER (PARTITION BY c)::DOUBLE AS nc, sum(n) OVER ()::DOUBLE AS total FROM g), x AS (SELECT *, nr * nc / total AS e FROM e)"
query("cohens_kappa", f"WITH {_RATERS} SELECT round(1 - sum(n) FILTER (r <> c) / sum(e) FILTER (r <> c), 6) AS kappa, round(sum(n) FILTER (r = c) / sum(n), 6) AS agreement FROM x")(lambda spark, d: C.kappa(table(spark, d, "labels"), "quality", "toxic"))
_SIZES = "t AS (SELECT p_size % 5 AS r, p_partkey % 5 AS c, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT r, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT r FROM t) CROSS JOIN (SELECT DISTINCT c FROM t) LEFT JOIN t USING (r, c)), e AS (SELECT *, sum(n) OVER (PARTITION BY r)::DOUBLE AS nr, sum(n) OVER (PARTITION BY c)::DOUBLE AS nc, sum(n) OVER ()::DOUBLE AS total FROM g), x AS (SELECT *, nr * nc / total AS e FROM e)"


def _sizes(spark, d):
    return table(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("x"), (F.col("p_partkey") % 5).cast("long").alias("y"))


for _w, _e in (("linear", "abs(r - c)"), ("quadratic", "(r - c) ** 2")):
    query(f"weighted_kappa_{_w}", f"WITH {_SIZES} SELECT round(1 - sum({_e} * n) / sum({_e} * e), 6) AS kappa, round(sum(n) FILTER (r = c) / sum(n), 6) AS agreement FROM x")(lambda spark, d, w=_w: C.kappa(_sizes(spark, d), "x", "y", w))
query("chance_agreement", f"WITH {_SIZES}, po AS (SELECT sum(n) FILTER (r = c)::DOUBLE / sum(n) AS po FROM x), s AS (SELECT k, sum(n)::DOUBLE / (2 * (SELECT sum(n) FROM x)) AS pi FROM (SELECT r AS k, n FROM x UNION ALL SELECT c, n FROM x) GROUP BY 1), pe AS (SELECT sum(pi * pi) AS scott, sum(pi * (1 - pi)) / (count(*) - 1) AS gwet, 1.0::DOUBLE / count(*) AS bp FROM s) SELECT round(po, 6) AS po, round((po - bp) / (1 - bp), 6) AS brennan_prediger, round((po - gwet) / (1 - gwet), 6) AS gwet_ac1, round((po - scott) / (1 - scott), 6) AS scott_pi FROM po, pe")(lambda spark, d: C.chance_agreement(_sizes(spark, d), "x", "y"))
query("ordinal_association", f"WITH {_SIZES}, p AS (SELECT sum(CASE WHEN a.c < b.c THEN a.n * b.n ELSE 0 END)::DOUBLE AS con, sum(CASE WHEN a.c > b.c THEN a.n * b.n ELSE 0 END)::DOUBLE AS dis FROM t a JOIN t b ON a.r < b.r), q AS (SELECT sum(n)::DOUBLE * (sum(n) - 1) / 2 AS al FROM t), tr AS (SELECT sum(m::DOUBLE * (m - 1) / 2) AS tr FROM (SELECT sum(n) AS m FROM t GROUP BY r)), tc AS (SELECT sum(m::DOUBLE * (m - 1) / 2) AS tc FROM (SELECT sum(n) AS m FROM t GROUP BY c)) SELECT CAST(con AS BIGINT) AS concordant, CAST(dis AS BIGINT) AS discordant, round((con - dis) / (con + dis), 6) AS gamma, round((con - dis) / (al - tr), 6) AS d_column, round((con - dis) / (al - tc), 6) AS d_row, round((con - dis) / sqrt((al - tr) * (al - tc)), 6) AS tau_b FROM p, q, tr, tc")(lambda spark, d: C.ordinal(_sizes(spark, d), "x", "y"))
query("clustering_agreement", f"WITH {_SIZES}, s AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ij, max(total) AS n, sum(CASE WHEN n > 0 THEN n / total * ln(n / e) ELSE 0 END) AS mi FROM x), a AS (SELECT sum(nr * (nr - 1) / 2) AS i, sum(-(nr / total) * ln(nr / total)) AS hr FROM (SELECT DISTINCT r, nr, total FROM x)), b AS (SELECT sum(nc * (nc - 1) / 2) AS j, sum(-(nc / total) * ln(nc / total)) AS hc FROM (SELECT DISTINCT c, nc, total FROM x)) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari, round(mi, 6) AS mi, round(2 * mi / (hr + hc), 6) AS nmi FROM s, a, b")(lambda spark, d: C.clustering_agreement(_sizes(spark, d), "x", "y"))

# groups
_GROUPS = "m AS (SELECT p_brand AS b, l_returnflag AS g, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _priced(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey")).select("brand", F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))


query("anova", f"WITH {_GROUPS}, s AS (SELECT b, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw, sum(n) AS n, count(*) AS k FROM m GROUP BY 1) SELECT b AS brand, round(ssb / (k - 1) / (ssw / (n - k)), 5) AS f, round({f_sf("ssb / (k - 1) / (ssw / (n - k))", "k - 1", "n - k")}, 5) AS p, round(ssb / (ssb + ssw), 5) AS eta_squared, round((ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)), 5) AS omega_squared, CAST(n AS BIGINT) AS n, k FROM s", 5)(lambda spark, d: M.anova(_priced(spark, d), ["brand"], "flag", "price"))
query("two_sample", f"WITH {_GROUPS}, x AS (SELECT a.b AS brand, a.m - r.m AS diff, a.n AS na, r.n AS nb, a.v AS va, r.v AS vb FROM m a JOIN m r ON a.b = r.b AND a.g = 'A' AND r.g = 'R'), y AS (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS p, va / na + vb / nb AS w FROM x) SELECT brand, round(diff, 4) AS difference, round(diff / sqrt(p * (1 / na + 1 / nb)), 4) AS t, round({t_two_sided("diff / sqrt(p * (1 / na + 1 / nb))", "na + nb - 2")}, 4) AS p, round(diff / sqrt(w), 4) AS welch_t, round({t_two_sided("diff / sqrt(w)", "w ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))")}, 4) AS welch_p, round(w ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS welch_df, round(diff / sqrt(p), 4) AS cohens_d, round(diff / sqrt(p) * (1 - 3 / (4 * (na + nb) - 9)), 4) AS hedges_g FROM y", 4)(lambda spark, d: M.two_sample(_priced(spark, d), ["brand"], "flag", "price", "A", "R"))
query("levene", f"WITH c AS (SELECT p_brand AS b, l_returnflag AS g, l_quantity AS x, quantile_cont(l_quantity, 0.5) OVER (PARTITION BY p_brand, l_returnflag) AS md FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT b, g, count(*)::DOUBLE AS n, avg(abs(x - md)) AS m, var_samp(abs(x - md)) AS v FROM c GROUP BY 1, 2), s AS (SELECT b, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw, sum(n) AS n, count(*) AS k FROM m GROUP BY 1) SELECT b AS brand, round(ssb / (k - 1) / (ssw / (n - k)), 5) AS w, round({f_sf("ssb / (k - 1) / (ssw / (n - k))", "k - 1", "n - k")}, 5) AS p, CAST(n AS BIGINT) AS n, k FROM s", 5)(lambda spark, d: M.levene(_priced(spark, d), ["brand"], "flag", "qty"))
_RANKED = "c AS (SELECT p_brand AS b, l_returnflag AS g, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey{w}), r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0::DOUBLE AS k FROM c), t AS (SELECT b, sum(n::DOUBLE ** 3 - n) AS ties FROM (SELECT b, x, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)"
query("kruskal_wallis", f"WITH {_RANKED.format(w='')}, s AS (SELECT b, g, sum(k) AS s, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2), h AS (SELECT b, sum(s * s / n) AS s2, sum(n) AS n, count(*) AS k FROM s GROUP BY 1), z AS (SELECT b, (12 / (n * (n + 1)) * s2 - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h, n, k FROM h JOIN t USING (b)) SELECT b AS brand, round(h, 5) AS h, round({chi2_sf("h", "k - 1")}, 5) AS p, round(h / (n - 1), 5) AS epsilon_squared, CAST(n AS BIGINT) AS n, k FROM z", 5)(lambda spark, d: M.rank_tests(_priced(spark, d), ["brand"], "flag", "qty"))
query("mann_whitney", "WITH " + _RANKED.format(w=" WHERE l_returnflag IN ('A', 'R')") + ", s AS (SELECT b, sum(k) FILTER (g = 'A') AS s, count(*) FILTER (g = 'A')::DOUBLE AS na, count(*) FILTER (g = 'R')::DOUBLE AS nb FROM r GROUP BY 1), u AS (SELECT *, s - na * (na + 1) / 2 AS u, na + nb AS n FROM s JOIN t USING (b)) SELECT b AS brand, round(u, 5) AS u, round(2 * u / (na * nb) - 1, 5) AS cliffs_delta, round((u - na * nb / 2) / sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1)))), 5) AS z, round(" + normal_two_sided("(u - na * nb / 2) / sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))") + ", 5) AS p FROM u", 5)(lambda spark, d: M.mann_whitney(_priced(spark, d), ["brand"], "flag", "qty", "A", "R"))
query("summary_quantiles", "WITH c AS (SELECT l_returnflag AS flag, l_extendedprice AS x FROM lineitem), q AS (SELECT flag, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM c GROUP BY 1) SELECT flag, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM c JOIN q USING (flag) GROUP BY 1", 4)(lambda spark, d: M.summary_quantiles(_priced(spark, d), ["flag"], "price"))
query("moments_shape", "WITH c AS (SELECT l_returnflag AS flag, l_quantity AS x, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), s AS (SELECT flag, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS sk, avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 AS ku, count(*) AS n FROM c GROUP BY 1) SELECT flag, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, n, round(n / 6 * (sk ** 2 + ku ** 2 / 4), 6) AS jarque_bera FROM s")(lambda spark, d: M.moments_shape(_priced(spark, d), ["flag"], "qty"))

# agreement
_PAIR = "x AS (SELECT l_extendedprice / 1000 AS a, l_quantity AS b FROM lineitem)"


def _pair(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("a"), F.col("l_quantity").alias("b"), F.col("l_returnflag").alias("flag"))


query("bland_altman", f"WITH {_PAIR}, s AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS s FROM x) SELECT n, round(m, 6) AS bias, round(s, 6) AS sd, round(m - {_Z} * s, 6) AS low, round(m + {_Z} * s, 6) AS high FROM s")(lambda spark, d: G.bland_altman(_pair(spark, d), "a", "b"))
query("concordance_correlation", f"WITH {_PAIR}, s AS (SELECT 2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2) AS c, corr(a, b) AS r FROM x) SELECT round(c, 6) AS ccc, round(r, 6) AS pearson, round(c / r, 6) AS bias_correction FROM s")(lambda spark, d: G.concordance(_pair(spark, d), "a", "b"))
query("linear_fit", "WITH x AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS a, l_quantity AS b FROM lineitem) SELECT flag, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 6) AS intercept, round(regr_r2(b, a), 6) AS r_squared, round(sqrt(count(*) * (var_pop(b) - covar_pop(a, b) ** 2 / var_pop(a)) / (count(*) - 2) / (count(*) * var_pop(a))), 6) AS se, count(*) AS n FROM x GROUP BY 1")(lambda spark, d: G.linear_fit(_pair(spark, d), "a", "b", ["flag"]))
query("cronbach_alpha", f"WITH {CELLS}, c AS (SELECT * FROM cells WHERE part IN (SELECT part FROM cells GROUP BY 1 HAVING count(*) = 3)), i AS (SELECT sum(v) AS vi, count(*) AS k FROM (SELECT var_samp(value) AS v FROM c GROUP BY flag)), t AS (SELECT var_samp(t) AS vt FROM (SELECT sum(value) AS t FROM c GROUP BY part)) SELECT round(k / (k - 1) * (1 - vi / vt), 6) AS alpha, k FROM i, t")(lambda spark, d: G.cronbach_alpha(cells(spark, d).join(cells(spark, d).groupBy("part").count().where("count = 3"), "part", "left_semi"), "part", "flag", "value"))

# curves
_ROC = SCORED + ", t AS (SELECT score AS threshold, sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS q FROM scored GROUP BY 1), r AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM t WINDOW w AS (ORDER BY threshold DESC))"
query("roc_curve", f"WITH {_ROC} SELECT threshold, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr FROM r")(lambda spark, d: R.roc_curve(scored(spark, d), "quality", "score"))
query("precision_recall_curve", f"WITH {_ROC} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM r")(lambda spark, d: R.precision_recall_curve(scored(spark, d), "quality", "score"))
query("roc_auc", f"WITH {_ROC} SELECT round(sum(q * (tp - p / 2)) / any_value(np * nq), 6) AS roc_auc, round(sum(p / np * tp / (tp + fp)), 6) AS average_precision FROM r")(lambda spark, d: R.auc(scored(spark, d), "quality", "score"))
query("youden_index", f"WITH {_ROC} SELECT threshold, round(tp / np, 6) AS tpr, round(fp / nq, 6) AS fpr, round(tp / np - fp / nq, 6) AS j FROM r ORDER BY round(tp / np - fp / nq, 12) DESC, threshold DESC LIMIT 1")(lambda spark, d: R.youden(scored(spark, d), "quality", "score"))
query("classification_metrics", f"WITH {SCORED}, c AS (SELECT count(*) FILTER (quality = 1 AND score >= 1500)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND score >= 1500)::DOUBLE AS fp, count(*) FILTER (quality = 1 AND score < 1500)::DOUBLE AS fn, count(*) FILTER (quality = 0 AND score < 1500)::DOUBLE AS tn FROM scored) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")(lambda spark, d: R.confusion(scored(spark, d), "quality", "score", 1500))
query("decision_curve", f"WITH {SCORED}, t AS (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS threshold), s AS (SELECT threshold, count(*) FILTER (quality = 1 AND risk >= threshold)::DOUBLE AS tp, count(*) FILTER (quality = 0 AND risk >= threshold)::DOUBLE AS fp, sum(quality)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored, t GROUP BY 1) SELECT threshold, round((tp - fp * (threshold / (1 - threshold))) / n, 6) AS net_benefit, round((pos - (n - pos) * (threshold / (1 - threshold))) / n, 6) AS treat_all FROM s")(lambda spark, d: R.decision_curve(scored(spark, d), "quality", "risk", [0.1, 0.2, 0.3]))
query("calibration", f"WITH {SCORED} SELECT CAST(least(floor(risk * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(risk), 6) AS mean_risk, round(avg(quality), 6) AS observed FROM scored GROUP BY 1")(lambda spark, d: R.calibration(scored(spark, d), "quality", "risk"))

# survival
_RISK = LIVES + ", t AS (SELECT grp, time, sum(event) AS d, sum(1 - event) AS c FROM lives GROUP BY 1, 2), r AS (SELECT *, sum(d + c) OVER (PARTITION BY grp ORDER BY time DESC) AS n FROM t), x AS (SELECT grp, time, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d FROM r WHERE d > 0)"
query("risk_table", f"WITH {_RISK} SELECT grp, time, CAST(d AS BIGINT) AS d, CAST(c AS BIGINT) AS c, CAST(n AS BIGINT) AS n FROM r")(lambda spark, d: L.risk_table(lives(spark, d), "time", "event", "grp"))
query("kaplan_meier", f"WITH {_RISK}, s AS (SELECT *, CASE WHEN max(CASE WHEN n = d THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN n > d THEN ln(1 - d / n) END) OVER w) END AS s, sum(CASE WHEN n > d THEN d::DOUBLE / (n * (n - d)) ELSE 0 END) OVER w AS g FROM x WINDOW w AS (PARTITION BY grp ORDER BY time)) SELECT grp, time, n, d, round(s, 6) AS survival, round(s * s * g, 6) AS variance FROM s")(lambda spark, d: L.kaplan_meier(lives(spark, d), "time", "event", "grp"))
query("nelson_aalen", f"WITH {_RISK} SELECT grp, time, n, d, round(sum(d::DOUBLE / n) OVER w, 6) AS hazard, round(sum(d::DOUBLE / (n::DOUBLE ** 2)) OVER w, 6) AS variance FROM x WINDOW w AS (PARTITION BY grp ORDER BY time)")(lambda spark, d: L.nelson_aalen(lives(spark, d), "time", "event", "grp"))
_HI, _LO = "1-URGENT", "5-LOW"
query("logrank_test", f"WITH {LIVES}, t AS (SELECT time, sum(event)::DOUBLE AS d, count(*) AS m, sum(CASE WHEN grp = '{_HI}' THEN event ELSE 0 END)::DOUBLE AS da, count(*) FILTER (grp = '{_HI}') AS ma FROM lives WHERE grp IN ('{_HI}', '{_LO}') GROUP BY 1), r AS (SELECT *, sum(m) OVER w::DOUBLE AS n, sum(ma) OVER w::DOUBLE AS na FROM t WINDOW w AS (ORDER BY time DESC)), s AS (SELECT sum(da) AS o, sum(d * na / n) AS e, sum(CASE WHEN n > 1 THEN d * na / n * (1 - na / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r WHERE d > 0) SELECT CAST(o AS BIGINT) AS observed, round(e, 5) AS expected, round(v, 5) AS variance, round((o - e) ** 2 / v, 5) AS chi2, round({chi2_sf("(o - e) ** 2 / v", "1")}, 5) AS p FROM s", 5)(lambda spark, d: L.logrank(lives(spark, d), "time", "event", "grp", _HI, _LO))
query("rmst", f"WITH {_RISK}, s AS (SELECT grp, time::DOUBLE AS time, exp(sum(ln(1 - d / n)) OVER (PARTITION BY grp ORDER BY time)) AS s FROM x WHERE time < 60), u AS (SELECT * FROM s UNION ALL SELECT DISTINCT grp, 0.0, 1.0 FROM lives), z AS (SELECT grp, time, s, coalesce(lead(time) OVER (PARTITION BY grp ORDER BY time, s DESC), 60.0) AS nxt FROM u) SELECT grp, round(sum((nxt - time) * s), 5) AS rmst FROM z GROUP BY 1", 5)(lambda spark, d: L.rmst(lives(spark, d), "time", "event", "grp", 60))

# series
_SERIES = "s AS (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE value IS NOT NULL)"
query("acf", f"WITH {_SERIES}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY key) AS x FROM s), q AS (SELECT key, sum(x * x) AS ss, count(*) AS n FROM c GROUP BY 1), l AS (SELECT unnest([1, 2, 3]) AS lag), p AS (SELECT a.key, l.lag, sum(a.x * b.x) AS p FROM c a JOIN l ON true JOIN c b ON a.key = b.key AND b.t = a.t - l.lag GROUP BY 1, 2) SELECT q.key, n, CAST(l.lag AS INT) AS lag, CASE WHEN ss > 0 THEN round(coalesce(p, 0) / ss, 6) END AS acf FROM q JOIN l ON true LEFT JOIN p ON p.key = q.key AND p.lag = l.lag")(lambda spark, d: T.acf(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 3))
query("order_statistics", f"WITH {_SERIES}, m AS (SELECT key, quantile_cont(v, 0.5) AS md, avg(v) AS m FROM s GROUP BY 1), x AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM s JOIN m USING (key) WINDOW w AS (PARTITION BY key ORDER BY t)), r AS (SELECT key, sum(CASE WHEN up IS DISTINCT FROM last THEN 1 ELSE 0 END) AS runs FROM (SELECT key, v > md AS up, lag(v > md) OVER (PARTITION BY key ORDER BY t) AS last FROM x WHERE v <> md) GROUP BY 1), a AS (SELECT key, count(*) AS n, count(*) FILTER (v > p) AS rises, count(*) FILTER ((v > p AND v > q) OR (v < p AND v < q)) AS turning_points, sum((v - p) ** 2) / nullif(sum((v - m) ** 2) FILTER (p IS NOT NULL OR p IS NULL), 0) AS vn FROM x GROUP BY 1) SELECT key, n, rises, turning_points, round(vn, 6) AS von_neumann, CAST(runs AS BIGINT) AS runs FROM a LEFT JOIN r USING (key)")(lambda spark, d: T.order_statistics(table(spark, d, "events").join(table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("value").alias("k")).where("k >= 1"), "user_id", "left_semi"), "user_id", ["ts", "event_id"], "value"))
query("moving_average", f"WITH {_SERIES}, w AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(v) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT key, t, round(v, 6) AS v, round(trend, 6) AS trend, round(v - trend, 6) AS rest FROM w")(lambda spark, d: T.moving_average(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 5))
query("seasonal_decompose", f"WITH {_SERIES}, w AS (SELECT *, (t - 1) % 3 AS phase, CASE WHEN count(*) OVER w = 3 THEN avg(v) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), m AS (SELECT key, phase, avg(v - trend) AS m FROM w GROUP BY 1, 2), z AS (SELECT key, phase, m - avg(m) OVER (PARTITION BY key) AS seasonal FROM m) SELECT key, t, round(v, 6) AS v, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(v - trend - seasonal, 6) AS rest FROM w JOIN z USING (key, phase)")(lambda spark, d: T.seasonal(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 3))
query("sessions", "WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY t) > 86400 OR lag(s) OVER (PARTITION BY user_id ORDER BY t) IS NULL THEN 1 ELSE 0 END AS new FROM s), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(s) - min(s) AS seconds FROM k GROUP BY 1, 2")(lambda spark, d: T.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 86400))

# ecology
_P = CELLS + ", p AS (SELECT flag, value AS v, value / sum(value) OVER (PARTITION BY flag) AS p, row_number() OVER (PARTITION BY flag ORDER BY value) AS i FROM cells WHERE value > 0)"
query("diversity", f"WITH {_P} SELECT flag, count(*) AS richness, sum(v) AS total, round(sum(-p * ln(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, round(1 / sum(p * p), 6) AS inverse_simpson, round(sum(-p * ln(p)) / ln(count(*)), 6) AS evenness, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini, round(max(p), 6) AS berger_parker FROM p GROUP BY 1")(lambda spark, d: E.diversity(cells(spark, d), "flag"))
query("hill_family", f"WITH {_P} SELECT flag, round(ln(sum(p ** 3)) / -2, 6) AS renyi, round((1 - sum(p ** 3)) / 2, 6) AS tsallis, round(sum(p ** 3) ** -0.5, 6) AS hill FROM p GROUP BY 1")(lambda spark, d: E.hill_family(cells(spark, d), "flag", q=3.0))
_RARE = "c AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)"
query("chao1", f"WITH {_RARE} SELECT s AS l_suppkey, count(*) AS observed, count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2, round(count(*) + count(*) FILTER (n = 1) * (count(*) FILTER (n = 1) - 1) / (2 * (count(*) FILTER (n = 2) + 1)), 6) AS chao1, round(1 - count(*) FILTER (n = 1) / sum(n), 6) AS coverage FROM c GROUP BY 1")(lambda spark, d: E.chao1(table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("value")), "l_suppkey"))

# sequences
query("kmer_count", f"WITH {DNA}, k AS (SELECT doc_id, seq[i:i+2] AS kmer FROM dna, range(1, greatest(len(seq) - 1, 1)) t(i)) SELECT doc_id AS key, kmer, count(*) AS n FROM k WHERE len(kmer) = 3 AND NOT contains(kmer, 'N') GROUP BY 1, 2")(lambda spark, d: Q.kmer_count(dna(spark, d), "doc_id", "seq", 3))
query("motif_scan", f"WITH {DNA}, k AS (SELECT doc_id, seq[i:i+2] AS k FROM dna, range(1, len(seq) + 1) t(i)) SELECT doc_id AS key, 'tay' AS motif, CAST(count(*) FILTER (k IN ('TAC', 'TAT')) AS INT) AS n FROM k GROUP BY 1 UNION ALL SELECT doc_id, 'rr', CAST(count(*) FILTER (k[1] IN ('A', 'G') AND k[2] IN ('A', 'G')) AS INT) FROM k GROUP BY 1")(lambda spark, d: Q.motif_scan(dna(spark, d), "doc_id", "seq", {"tay": "TAY", "rr": "RR"}))
query("sequence_stats", f"WITH {DNA} SELECT doc_id AS key, CAST(len(seq) AS INT) AS length, round(len(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(len(regexp_replace(seq, '[^ACGT]', '', 'g')), 0), 6) AS gc, round(len(regexp_replace(seq, '[^N]', '', 'g')) / nullif(len(seq), 0), 6) AS n_share FROM dna")(lambda spark, d: Q.sequence_stats(dna(spark, d), "doc_id", "seq"))
query("composition", f"WITH {DNA}, k AS (SELECT doc_id AS key, seq[i] AS letter, count(*) AS n FROM dna, range(1, len(seq) + 1) t(i) GROUP BY 1, 2) SELECT key, letter, n, round(n / sum(n) OVER (PARTITION BY key), 6) AS share FROM k")(lambda spark, d: Q.composition(dna(spark, d), "doc_id", "seq"))
query("reverse_complement", f"WITH {DNA} SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS md5 FROM dna")(lambda spark, d: Q.reverse_complement(dna(spark, d), "seq").select("doc_id", F.md5("reverse_complement").alias("md5")))
query("sequence_deduplicate", "SELECT md5(text) AS md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")(lambda spark, d: Q.deduplicate(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select(F.md5("text").alias("md5"), "doc_id", "copies"))
query("linguistic_complexity", f"WITH {DNA}, k AS (SELECT doc_id AS key, count(DISTINCT seq[i:i+2]) AS d, count(*) AS t FROM dna, range(1, len(seq) - 1) t(i) WHERE len(seq) >= 3 GROUP BY 1) SELECT key, d AS \"distinct\", t AS total, round(d / least(64, t), 6) AS complexity FROM k")(lambda spark, d: Q.linguistic_complexity(dna(spark, d), "doc_id", "seq", 3))

# genetics
query("allele_stats", f"WITH {DOSAGES}, s AS (SELECT variant, count(*)::DOUBLE AS n, sum(dosage) / (2 * count(*)) AS p, count(*) FILTER (dosage = 0)::DOUBLE AS n0, count(*) FILTER (dosage = 1)::DOUBLE AS n1, count(*) FILTER (dosage = 2)::DOUBLE AS n2 FROM dosages GROUP BY 1), e AS (SELECT *, 2 * p * (1 - p) AS he FROM s) SELECT variant, CAST(n AS BIGINT) AS n, 0.0 AS missing, round(p, 6) AS p, round(least(p, 1 - p), 6) AS maf, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(he, 6) AS expected_het, round(n1 / n, 6) AS observed_het, round(1 - n1 / n / he, 6) AS inbreeding, round((n0 - n * (1 - p) ** 2) ** 2 / (n * (1 - p) ** 2) + (n1 - n * he) ** 2 / (n * he) + (n2 - n * p ** 2) ** 2 / (n * p ** 2), 6) AS hwe_chi2 FROM e")(lambda spark, d: N.allele_stats(dosages(spark, d), "variant", "dosage"))
query("maf", f"WITH {DOSAGES} SELECT variant, sample, CAST(dosage AS BIGINT) AS dosage FROM dosages WHERE variant IN (SELECT variant FROM dosages GROUP BY 1 HAVING least(sum(dosage) / (2 * count(*)), 1 - sum(dosage) / (2 * count(*))) >= 0.49)")(lambda spark, d: N.maf_filter(dosages(spark, d), "variant", "dosage", 0.49))
query("ld", f"WITH {DOSAGES} SELECT x.variant AS a, y.variant AS b, count(*) AS n, round(corr(x.dosage, y.dosage) ** 2, 6) AS r2 FROM dosages x JOIN dosages y ON x.sample = y.sample AND y.variant - x.variant BETWEEN 1 AND 3 GROUP BY 1, 2 HAVING var_pop(x.dosage) > 0 AND var_pop(y.dosage) > 0")(lambda spark, d: N.ld(dosages(spark, d), "variant", "sample", "dosage", 3).where("r2 is not null"))
query("polygenic_score", f"WITH {DOSAGES} SELECT sample, round(sum(dosage * ((variant % 7) - 3) / 10.0), 6) AS score, count(dosage) AS n FROM dosages GROUP BY 1")(lambda spark, d: N.polygenic_score(dosages(spark, d), dosages(spark, d).select("variant").distinct().withColumn("w", (F.col("variant") % 7 - 3) / 10), "variant", "sample", "dosage", "w"))
query("genotype_association", f"WITH {DOSAGES}, x AS (SELECT variant, dosage AS a, (sample * 37 % 101)::DOUBLE AS b FROM dosages) SELECT variant, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 6) AS intercept, round(regr_r2(b, a), 6) AS r_squared, round(sqrt(count(*) * (var_pop(b) - covar_pop(a, b) ** 2 / var_pop(a)) / (count(*) - 2) / (count(*) * var_pop(a))), 6) AS se, count(*) AS n FROM x GROUP BY 1")(lambda spark, d: N.association_score(dosages(spark, d), dosages(spark, d).select("sample").distinct().withColumn("y", (F.col("sample") * 37 % 101).cast("double")), "variant", "sample", "dosage", "y"))

"""Queries over the tests with probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import hypotheses as H
from tessella.operators import series as T
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, SCORED, cells, pvalues, PVALUES, scored, table
from tessella.plans.tails import beta, chi2_sf, choose, f_sf, normal_sf, normal_two_sided, poisson_cdf, t_two_sided

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql, places=6):
    def add(f):
        QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
        SQL[name] = sql
        return f

    return add


# lineitem by brand and flag
_ROWS = "pr AS (SELECT p_brand AS brand, l_returnflag AS g, l_quantity AS q, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey)"
_M = _ROWS + ", m AS (SELECT brand, g, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM pr GROUP BY 1, 2)"
_TWO = _M + ", two AS (SELECT a.brand, a.n AS na, r.n AS nb, a.m AS ma, r.m AS mb, a.v AS va, r.v AS vb FROM m a JOIN m r ON a.brand = r.brand AND a.g = 'A' AND r.g = 'R')"


def _rows(spark, d):
    brands = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return table(spark, d, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey")).select("brand", F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("x"), "l_linestatus", "l_linenumber")


# parts that have both flags, in five classes
_PAIRS = CELLS + ", pa AS (SELECT part % 5 AS k, part, max(value) FILTER (flag = 'A') AS x, max(value) FILTER (flag = 'R') AS y FROM cells GROUP BY 1, 2), pp AS (SELECT * FROM pa WHERE x IS NOT NULL AND y IS NOT NULL)"


def _pairs(spark, d):
    return H.pairs_of(cells(spark, d).withColumn("k", F.col("part") % 5), ["k"], "part", "flag", "value", "A", "R")


query("ttest_one_sample", f"WITH {_ROWS}, s AS (SELECT brand, count(*) AS n, avg(q) AS mean, (avg(q) - 25) / (stddev_samp(q) / sqrt(count(*))) AS t FROM pr GROUP BY 1) SELECT brand, n, round(mean, 6) AS mean, round(t, 6) AS t, round({t_two_sided('t', 'n - 1')}, 6) AS p FROM s")(lambda spark, d: H.one_sample_t(_rows(spark, d), ["brand"], "q", 25.0))
query("ttest_one_sample_greater", f"WITH {_ROWS}, s AS (SELECT brand, count(*) AS n, avg(q) AS mean, (avg(q) - 25) / (stddev_samp(q) / sqrt(count(*))) AS t FROM pr GROUP BY 1), z AS (SELECT *, {t_two_sided('t', 'n - 1')} AS p FROM s) SELECT brand, n, round(mean, 6) AS mean, round(t, 6) AS t, round(CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p FROM z")(lambda spark, d: H.one_sample_t(_rows(spark, d), ["brand"], "q", 25.0, "greater"))
query("ttest_paired", f"WITH {_PAIRS}, s AS (SELECT k, count(*) AS n, avg(x - y) AS difference, avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) AS t FROM pp GROUP BY 1) SELECT k, n, round(difference, 6) AS difference, round(t, 6) AS t, round({t_two_sided('t', 'n - 1')}, 6) AS p FROM s")(lambda spark, d: H.paired_t(_pairs(spark, d), ["k"]))
_WELCH = _M + ", w AS (SELECT *, n / v AS w FROM m), c AS (SELECT brand, sum(w) AS sw, sum(w * m) / sum(w) AS c, count(*) AS k FROM w GROUP BY 1), l AS (SELECT brand, any_value(k) AS k, sum(w * (m - c) ** 2) / (any_value(k) - 1) AS a, sum((1 - w / sw) ** 2 / (n - 1)) AS l FROM w JOIN c USING (brand) GROUP BY 1), f AS (SELECT brand, a / (1 + 2 * (k - 2) / (k ** 2 - 1) * l) AS f, k - 1 AS df1, (k ** 2 - 1) / (3 * l) AS df2 FROM l)"
query("welch_anova", f"WITH {_WELCH} SELECT brand, round(f, 5) AS f, df1, round(df2, 5) AS df2, round({f_sf('f', 'df1', 'df2')}, 5) AS p FROM f", 5)(lambda spark, d: H.welch_anova(_rows(spark, d), ["brand"], "g", "x"))
_ANOVA = _M + ", s AS (SELECT brand, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * v) AS ssw, sum(n) AS n, count(*) AS k FROM m GROUP BY 1)"
query("eta_squared", f"WITH {_ANOVA} SELECT brand, round(ssb / (ssb + ssw), 6) AS eta_squared FROM s")(lambda spark, d: _anova(spark, d).select("brand", "eta_squared"))
_T = _TWO + ", t AS (SELECT *, ma - mb AS d, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS pooled, va / na + vb / nb AS w FROM two)"
query("cohens_d", f"WITH {_T} SELECT brand, round(d / sqrt(pooled), 6) AS cohens_d FROM t")(lambda spark, d: _two_sample(spark, d).select("brand", "cohens_d"))
query("ttest", f"WITH {_T}, u AS (SELECT brand, d / sqrt(pooled * (1 / na + 1 / nb)) AS t, na + nb - 2 AS df, d / sqrt(w) AS wt, w ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS wdf FROM t) SELECT brand, round(t, 5) AS t, round({t_two_sided('t', 'df')}, 5) AS p, round(wt, 5) AS welch_t, round({t_two_sided('wt', 'wdf')}, 5) AS welch_p FROM u", 5)(lambda spark, d: _two_sample(spark, d).select("brand", "t", "p", "welch_t", "welch_p"))


def _anova(spark, d):
    from tessella.operators.groups import anova

    return anova(_rows(spark, d), ["brand"], "g", "x")


def _two_sample(spark, d):
    from tessella.operators.groups import two_sample

    return two_sample(_rows(spark, d), ["brand"], "g", "x", "A", "R")


_TOST = _TWO + ", t AS (SELECT brand, ma - mb AS d, sqrt(va / na + vb / nb) AS se, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM two), u AS (SELECT brand, d, (d + 3000) / se AS lo, (d - 3000) / se AS hi, df FROM t)"
_one = lambda t, up: f"(CASE WHEN {t} {'>' if up else '<'} 0 THEN {t_two_sided(t, 'df')} / 2 ELSE 1 - {t_two_sided(t, 'df')} / 2 END)"
query("tost_equivalence", f"WITH {_TOST} SELECT brand, round(d, 4) AS difference, round(lo, 4) AS t_low, round(hi, 4) AS t_high, round(df, 4) AS df, round(greatest({_one('lo', True)}, {_one('hi', False)}), 4) AS p FROM u", 4)(lambda spark, d: H.equivalence(_rows(spark, d), ["brand"], "g", "x", "A", "R", -3000.0, 3000.0))

# ranks
_D = _PAIRS + ", dd AS (SELECT k, x - y AS d, abs(x - y) AS a FROM pp WHERE x <> y), r AS (SELECT *, count(*) OVER (PARTITION BY k, a) AS t, rank() OVER (PARTITION BY k ORDER BY a) + (count(*) OVER (PARTITION BY k, a) - 1) / 2.0::DOUBLE AS r FROM dd), s AS (SELECT k, count(*)::DOUBLE AS n, sum(r) FILTER (d > 0) AS w, sum(t::DOUBLE ** 2 - 1) AS ties FROM r GROUP BY 1), z AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s)"
query("wilcoxon", f"WITH {_D} SELECT k, CAST(n AS BIGINT) AS n, round(w, 6) AS w_plus, round(n * (n + 1) / 2 - w, 6) AS w_minus, round(z, 6) AS z, round({normal_two_sided('z')}, 6) AS p FROM z")(lambda spark, d: H.wilcoxon(_pairs(spark, d), ["k"]))
_pmf = lambda i, n: f"exp({choose(n, i)} - ({n}) * ln(2.0::DOUBLE))"
query("sign_test", f"WITH {_PAIRS}, s AS (SELECT k, count(*) FILTER (x > y) AS above, count(*) FILTER (x < y) AS below FROM pp GROUP BY 1) SELECT k, above, below, round(least(1, list_sum(list_transform(range(0, above + below + 1), lambda i: CASE WHEN {_pmf('i', '(above + below)')} <= {_pmf('above', '(above + below)')} * (1 + 1e-7::DOUBLE) THEN {_pmf('i', '(above + below)')} ELSE 0 END))), 6) AS p FROM s")(lambda spark, d: H.sign_test(_pairs(spark, d), ["k"]))


def _ranked(where: str = "", key: str = "brand", group: str = "g", value: str = "q") -> str:
    return _ROWS + f", r AS (SELECT brand, g, q, rank() OVER (PARTITION BY brand ORDER BY q) + (count(*) OVER (PARTITION BY brand, q) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY brand, q)::DOUBLE AS t FROM pr{where})"


_AR = " WHERE g IN ('A', 'R')"
_BM = _ranked(_AR) + ", o AS (SELECT *, rank() OVER (PARTITION BY brand, g ORDER BY q) + (count(*) OVER (PARTITION BY brand, g, q) - 1) / 2.0::DOUBLE AS own FROM r), v AS (SELECT brand, g, count(*)::DOUBLE AS n, avg(r) AS m, var_samp(r - own) AS v FROM o GROUP BY 1, 2), b AS (SELECT a.brand, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb FROM v a JOIN v b ON a.brand = b.brand AND a.g = 'A' AND b.g = 'R'), z AS (SELECT brand, (mb - (nb + 1) / 2) / na AS larger, na * nb * (mb - ma) / (na + nb) / sqrt(na * va + nb * vb) AS s, (na * va + nb * vb) ** 2 / ((na * va) ** 2 / (na - 1) + (nb * vb) ** 2 / (nb - 1)) AS df FROM b)"
query("brunner_munzel", f"WITH {_BM} SELECT brand, round(larger, 5) AS larger, round(s, 5) AS statistic, round(df, 5) AS df, round({t_two_sided('s', 'df')}, 5) AS p FROM z", 5)(lambda spark, d: H.brunner_munzel(_rows(spark, d), ["brand"], "g", "q", "A", "R"))
_MED = _ROWS + ", h AS (SELECT brand, quantile_cont(q, 0.5) AS median FROM pr GROUP BY 1), c AS (SELECT brand, median, g, count(*) FILTER (q > median)::DOUBLE AS o, count(*)::DOUBLE AS n FROM pr JOIN h USING (brand) GROUP BY 1, 2, 3), e AS (SELECT *, n * sum(o) OVER w / sum(n) OVER w AS e1, n * (1 - sum(o) OVER w / sum(n) OVER w) AS e0 FROM c WINDOW w AS (PARTITION BY brand)), x AS (SELECT brand, any_value(median) AS median, sum((o - e1) ** 2 / e1 + (n - o - e0) ** 2 / e0) AS chi2, count(*) - 1 AS df FROM e GROUP BY 1)"
query("mood_median_test", f"WITH {_MED} SELECT brand, round(median, 6) AS median, round(chi2, 6) AS chi2, df, round({chi2_sf('chi2', 'df')}, 6) AS p FROM x")(lambda spark, d: H.median_test(_rows(spark, d), ["brand"], "g", "q"))
_MOOD = _ranked(_AR) + ", c AS (SELECT *, count(*) OVER (PARTITION BY brand)::DOUBLE AS n FROM r), s AS (SELECT brand, any_value(n) AS n, count(*)::DOUBLE AS na, sum((r - (n + 1) / 2) ** 2) AS m FROM c WHERE g = 'A' GROUP BY 1), z AS (SELECT *, (m - na * (n * n - 1) / 12) / sqrt(na * (n - na) * (n + 1) * (n + 2) * (n - 2) / 180) AS z FROM s)"
query("mood_scale", f"WITH {_MOOD} SELECT brand, round(m, 4) AS statistic, round(z, 4) AS z, round({normal_two_sided('z')}, 4) AS p FROM z", 4)(lambda spark, d: H.mood_scale(_rows(spark, d), ["brand"], "g", "q", "A", "R"))
_SUMS = _ranked() + ", s AS (SELECT brand, g, count(*)::DOUBLE AS n, sum(r) AS s, sum(r * r) AS s2 FROM r GROUP BY 1, 2), t AS (SELECT brand, count(*)::DOUBLE AS al, sum(t * t - 1) AS ties FROM r GROUP BY 1), ab AS (SELECT a.brand, a.g AS a, b.g AS b, a.n AS na, b.n AS nb, a.s / a.n - b.s / b.n AS d FROM s a JOIN s b ON a.brand = b.brand AND a.g < b.g)"
query("dunn_test", f"WITH {_SUMS}, z AS (SELECT *, d / sqrt((al * (al + 1) / 12 - ties / (12 * (al - 1))) * (1 / na + 1 / nb)) AS z FROM ab JOIN t USING (brand)) SELECT brand, a, b, round(z, 5) AS z, round({normal_two_sided('z')}, 5) AS p, round(least(1, 3 * {normal_two_sided('z')}), 5) AS adjusted FROM z", 5)(lambda spark, d: H.dunn(_rows(spark, d), ["brand"], "g", "q"))
query("conover_test", f"WITH {_SUMS}, w AS (SELECT brand, count(*) AS k, sum(s * s / n) AS q, sum(s2) AS r2 FROM s GROUP BY 1), h AS (SELECT *, (r2 - al * (al + 1) ** 2 / 4) / (al - 1) AS v FROM w JOIN t USING (brand)), z AS (SELECT brand, a, b, al - k AS df, d / sqrt(v * (al - 1 - (q - al * (al + 1) ** 2 / 4) / v) / (al - k) * (1 / na + 1 / nb)) AS z FROM ab JOIN h USING (brand)) SELECT brand, a, b, round(z, 5) AS t, round({t_two_sided('z', 'df')}, 5) AS p FROM z", 5)(lambda spark, d: H.conover(_rows(spark, d), ["brand"], "g", "q"))
_MM = "ab AS (SELECT a.brand, a.g AS a, b.g AS b, a.n AS na, b.n AS nb, a.m - b.m AS d, a.v AS va, b.v AS vb FROM m a JOIN m b ON a.brand = b.brand AND a.g < b.g)"
query("scheffe_test", f"WITH {_ANOVA}, {_MM}, z AS (SELECT brand, a, b, d, k - 1 AS df1, n - k AS df2, d ** 2 / (ssw / (n - k) * (1 / na + 1 / nb) * (k - 1)) AS f FROM ab JOIN s USING (brand)) SELECT brand, a, b, round(d, 5) AS difference, round(f, 5) AS f, round({f_sf('f', 'df1', 'df2')}, 5) AS p FROM z", 5)(lambda spark, d: H.scheffe(_rows(spark, d), ["brand"], "g", "x"))
query("tamhane_t2", f"WITH {_M}, {_MM}, z AS (SELECT brand, a, b, d / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df FROM ab) SELECT brand, a, b, round(t, 5) AS t, round(df, 5) AS df, round(1 - (1 - {t_two_sided('t', 'df')}) ** 3, 5) AS p FROM z", 5)(lambda spark, d: H.tamhane(_rows(spark, d), ["brand"], "g", "x"))
_CUZ = _ROWS + ", nn AS (SELECT p_brand AS brand, l_linenumber AS g, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY q) + (count(*) OVER (PARTITION BY brand, q) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY brand, q)::DOUBLE AS t FROM nn), s AS (SELECT brand, sum(g * r) AS t, sum(g)::DOUBLE AS l, sum(g * g)::DOUBLE AS l2, count(*)::DOUBLE AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1), z AS (SELECT brand, t, (t - (n + 1) * l / 2) / sqrt((n + 1) / 12 * (n * l2 - l * l) * (1 - ties / (n ** 3 - n))) AS z FROM s)"
query("cuzick_test", f"WITH {_CUZ} SELECT brand, round(t, 5) AS statistic, round(z, 5) AS z, round({normal_two_sided('z')}, 5) AS p FROM z", 5)(lambda spark, d: H.cuzick(_rows(spark, d), ["brand"], "l_linenumber", "q"))

# dispersion
query("bartlett", f"WITH {_M}, s AS (SELECT brand, count(*) AS k, sum(n - 1) AS f, sum((n - 1) * v) AS ss, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS i FROM m GROUP BY 1), z AS (SELECT brand, k - 1 AS df, (f * ln(ss / f) - l) / (1 + (i - 1 / f) / (3 * (k - 1))) AS c FROM s) SELECT brand, round(c, 6) AS chi2, df, round({chi2_sf('c', 'df')}, 6) AS p FROM z")(lambda spark, d: H.bartlett(_rows(spark, d), ["brand"], "g", "x"))
query("var_test", f"WITH {_TWO}, z AS (SELECT brand, va / vb AS f, na - 1 AS df1, nb - 1 AS df2 FROM two), y AS (SELECT *, {f_sf('f', 'df1', 'df2')} AS p FROM z) SELECT brand, round(f, 5) AS f, round(2 * least(p, 1 - p), 5) AS p FROM y", 5)(lambda spark, d: H.var_test(_rows(spark, d), ["brand"], "g", "x", "A", "R"))
query("cochran_c_test", f"WITH {_M}, s AS (SELECT brand, max(v) / sum(v) AS c, avg(n) AS n, count(*) AS k FROM m GROUP BY 1), z AS (SELECT *, c * (k - 1) / (1 - c) AS f, n - 1 AS df1, (n - 1) * (k - 1) AS df2 FROM s) SELECT brand, round(c, 5) AS c, k, round(least(1, k * {f_sf('f', 'df1', 'df2')}), 5) AS p FROM z", 5)(lambda spark, d: H.cochran_c(_rows(spark, d), ["brand"], "g", "x"))

# normality
_MOM = _ROWS + ", a AS (SELECT brand, x, avg(x) OVER (PARTITION BY brand) AS m FROM pr), s AS (SELECT brand, count(*)::DOUBLE AS n, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS g, avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 AS k FROM a GROUP BY 1 HAVING count(*) >= 20), b AS (SELECT *, n / 6 * (g ** 2 + (k - 3) ** 2 / 4) AS jb, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2, (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS be FROM s), c AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS u, 6 + 8 / be * (2 / be + sqrt(1 + 4 / be ** 2)) AS a FROM b), e AS (SELECT *, ln(u + sqrt(u * u + 1)) / sqrt(0.5 * ln(w2)) AS zs, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS part FROM c), z AS (SELECT *, (1 - 2 / (9 * a) - sign(part) * abs(part) ** (1.0::DOUBLE / 3)) / sqrt(2 / (9 * a)) AS zk FROM e), k AS (SELECT *, zs * zs + zk * zk AS k2 FROM z)"
query("normaltest", f"WITH {_MOM} SELECT brand, CAST(n AS BIGINT) AS n, round(g, 5) AS skewness, round(k, 5) AS kurtosis, round(jb, 5) AS jarque_bera, round(zs, 5) AS z_skewness, round(zk, 5) AS z_kurtosis, round(k2, 5) AS k2, round({chi2_sf('jb', '2')}, 5) AS p_jarque_bera, round({normal_two_sided('zs')}, 5) AS p_skewness, round({normal_two_sided('zk')}, 5) AS p_kurtosis, round({chi2_sf('k2', '2')}, 5) AS p_k2 FROM k", 5)(lambda spark, d: H.normality(_rows(spark, d), ["brand"], "x"))
query("jarque_bera", f"WITH {_MOM} SELECT brand, round(jb, 5) AS jarque_bera, round({chi2_sf('jb', '2')}, 5) AS p_jarque_bera FROM k", 5)(lambda spark, d: H.normality(_rows(spark, d), ["brand"], "x").select("brand", "jarque_bera", "p_jarque_bera"))
query("agostino_test", f"WITH {_MOM} SELECT brand, round(g, 5) AS skewness, round(zs, 5) AS z_skewness, round({normal_two_sided('zs')}, 5) AS p_skewness FROM k", 5)(lambda spark, d: H.normality(_rows(spark, d), ["brand"], "x").select("brand", "skewness", "z_skewness", "p_skewness"))
query("anscombe_test", f"WITH {_MOM} SELECT brand, round(k, 5) AS kurtosis, round(zk, 5) AS z_kurtosis, round({normal_two_sided('zk')}, 5) AS p_kurtosis FROM k", 5)(lambda spark, d: H.normality(_rows(spark, d), ["brand"], "x").select("brand", "kurtosis", "z_kurtosis", "p_kurtosis"))
query("bonett_seier", f"WITH {_ROWS}, a AS (SELECT brand, x, avg(x) OVER (PARTITION BY brand) AS m FROM pr), s AS (SELECT brand, count(*) AS n, avg(abs(x - m)) AS tau, sqrt(avg((x - m) ** 2)) AS sd FROM a GROUP BY 1), z AS (SELECT *, sqrt(n + 2) * (13.29 * (ln(sd) - ln(tau)) - 3) / 3.54 AS z FROM s) SELECT brand, round(tau, 5) AS tau, round(z, 5) AS z, round({normal_two_sided('z')}, 5) AS p FROM z", 5)(lambda spark, d: H.bonett_seier(_rows(spark, d), ["brand"], "x"))

# counts
query("chi_square_gof", f"WITH {_ROWS}, o AS (SELECT brand, g, count(*)::DOUBLE AS o FROM pr GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER w / count(*) OVER w AS e, count(*) OVER w AS k FROM o WINDOW w AS (PARTITION BY brand)), s AS (SELECT brand, sum(o) AS n, sum((o - e) ** 2 / e) AS c, any_value(k) - 1 AS df, 2 * sum(o * ln(o / e)) AS l FROM e GROUP BY 1) SELECT brand, CAST(n AS BIGINT) AS n, round(c, 5) AS chi2, df, round({chi2_sf('c', 'df')}, 5) AS p, round(l, 5) AS g, round({chi2_sf('l', 'df')}, 5) AS p_g FROM s", 5)(lambda spark, d: H.chi_square_gof(_rows(spark, d), ["brand"], "g"))
_GIVEN = "CASE g WHEN 'A' THEN 0.25 WHEN 'N' THEN 0.5 ELSE 0.25 END"
query("chisq_gof", f"WITH {_ROWS}, o AS (SELECT brand, g, count(*)::DOUBLE AS o FROM pr GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY brand) * {_GIVEN} AS e FROM o), s AS (SELECT brand, sum(o) AS n, sum((o - e) ** 2 / e) AS c, 2 * sum(o * ln(o / e)) AS l FROM e GROUP BY 1) SELECT brand, CAST(n AS BIGINT) AS n, round(c, 5) AS chi2, CAST(2 AS BIGINT) AS df, round({chi2_sf('c', '2')}, 5) AS p, round(l, 5) AS g, round({chi2_sf('l', '2')}, 5) AS p_g FROM s", 5)(lambda spark, d: H.chi_square_gof(_rows(spark, d), ["brand"], "g", {"A": 1, "N": 2, "R": 1}))
_B = "s AS (SELECT quality, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels GROUP BY 1)"
_bp = lambda i: f"exp({choose('n', i)} + ({i}) * ln(0.125::DOUBLE) + (n - ({i})) * ln(0.875::DOUBLE))"
query("binomial_test", f"WITH {_B} SELECT quality, k, n, round(k / n, 6) AS share, round(least(1, list_sum(list_transform(range(0, n + 1), lambda i: CASE WHEN {_bp('i')} <= {_bp('k')} * (1 + 1e-7::DOUBLE) THEN {_bp('i')} ELSE 0 END))), 6) AS p FROM s")(lambda spark, d: H.binomial_test(table(spark, d, "labels"), ["quality"], F.col("toxic") == 1, 0.125))
query("poisson_test", f"WITH s AS (SELECT p_brand AS brand, count(*) FILTER (p_size = 1)::DOUBLE AS k, count(*)::DOUBLE AS n FROM part GROUP BY 1), u AS (SELECT *, n * 0.02 AS mean FROM s) SELECT brand, CAST(k AS BIGINT) AS events, CAST(n AS BIGINT) AS exposure, round(k / mean, 6) AS ratio, round(1 - {poisson_cdf('k - 1', 'mean')}, 6) AS p_greater, round({poisson_cdf('k', 'mean')}, 6) AS p_less FROM u")(lambda spark, d: H.poisson_test(table(spark, d, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") == 1).cast("long").alias("e")), ["brand"], "e", 0.02))
_hg = lambda i: f"exp({choose('r', i)} + {choose('n - r', f'c - ({i})')} - {choose('n', 'c')})"
query("fisher_exact", f"WITH s AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c, count(*) FILTER (quality <> 1 AND toxic <> 1) AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1), m AS (SELECT lang, a AS k, b, c AS cc, d, a + b AS r, a + c AS c, a + b + c + d AS n FROM s), p AS (SELECT *, coalesce(list_sum(list_transform(range(greatest(k, c - (n - r)), least(r, c) + 1), lambda i: {_hg('i')})), 0) AS up, coalesce(list_sum(list_transform(range(greatest(k + 1, c - (n - r)), least(r, c) + 1), lambda i: {_hg('i')})), 0) AS more FROM m) SELECT lang, k AS a, b, cc AS c, d, CASE WHEN b * cc > 0 THEN round(k * d / (b * cc), 6) END AS odds_ratio, round(least(up, 1), 6) AS p_greater, round(1 - least(more, 1), 6) AS p_less FROM p")(lambda spark, d: H.fisher_exact(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), ["lang"], F.col("quality") == 1, F.col("toxic") == 1))
query("cochran_armitage", f"WITH c AS (SELECT p_brand AS brand, l_linenumber::DOUBLE AS w, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS r, count(*)::DOUBLE AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT *, sum(r) OVER k / sum(n) OVER k AS p FROM c WINDOW k AS (PARTITION BY brand)), s AS (SELECT brand, sum(w * (r - n * p)) / sqrt(any_value(p) * (1 - any_value(p)) * (sum(w * w * n) - sum(w * n) ** 2 / sum(n))) AS z FROM t GROUP BY 1) SELECT brand, round(z, 6) AS z, round({normal_two_sided('z')}, 6) AS p FROM s")(lambda spark, d: H.cochran_armitage(_rows(spark, d), ["brand"], "l_linenumber", F.col("g") == "R"))
_STRATA = "st AS (SELECT p_brand AS k, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 1)::DOUBLE AS a, count(*) FILTER (l_returnflag = 'R' AND l_linenumber <> 1)::DOUBLE AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber = 1)::DOUBLE AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber <> 1)::DOUBLE AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _strata(spark, d):
    r, one = F.col("g") == "R", F.col("l_linenumber") == 1
    return _rows(spark, d).groupBy("brand").agg(F.count_if(r & one).alias("a"), F.count_if(r & ~one).alias("b"), F.count_if(~r & one).alias("c"), F.count_if(~r & ~one).alias("d"))


query("woolf_test", f"WITH {_STRATA}, l AS (SELECT ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) AS l, 1 / (1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)) AS w FROM st), m AS (SELECT sum(w * l) / sum(w) AS m FROM l), s AS (SELECT sum(w * (l - m) ** 2) AS c, count(*) - 1 AS df, any_value(m) AS m FROM l, m) SELECT round(c, 6) AS chi2, df, round({chi2_sf('c', 'df')}, 6) AS p, round(exp(m), 6) AS pooled FROM s")(lambda spark, d: H.woolf(_strata(spark, d)))
query("stuart_maxwell", f"WITH t AS (SELECT p_size % 3 AS x, p_partkey % 3 AS y FROM part), q AS (SELECT count(*) FILTER (x = 0 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND y = 0)::DOUBLE AS b, count(*) FILTER (x = 0 AND y = 2)::DOUBLE AS c, count(*) FILTER (x = 2 AND y = 0)::DOUBLE AS d, count(*) FILTER (x = 1 AND y = 2)::DOUBLE AS e, count(*) FILTER (x = 2 AND y = 1)::DOUBLE AS f FROM t), m AS (SELECT (a + c) - (b + d) AS d1, (b + e) - (a + f) AS d2, (a + b + c + d) AS v1, (a + b + e + f) AS v2, -(a + b) AS v12 FROM q), s AS (SELECT (d1 * d1 * v2 - 2 * d1 * d2 * v12 + d2 * d2 * v1) / (v1 * v2 - v12 * v12) AS c FROM m) SELECT round(c, 6) AS chi2, CAST(2 AS BIGINT) AS df, round({chi2_sf('c', '2')}, 6) AS p FROM s")(lambda spark, d: H.stuart_maxwell(table(spark, d, "part").select((F.col("p_size") % 3).cast("long").alias("x"), (F.col("p_partkey") % 3).cast("long").alias("y")), "x", "y"))

# series
_SERIES = "s AS (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE value IS NOT NULL)"
_events = lambda spark, d: table(spark, d, "events")
_ORDER = ["ts", "event_id"]
_LB = _SERIES + ", c AS (SELECT *, v - avg(v) OVER (PARTITION BY key) AS x FROM s), q AS (SELECT key, sum(x * x) AS ss, count(*) AS n FROM c GROUP BY 1), l AS (SELECT unnest([1, 2, 3]) AS lag), p AS (SELECT a.key, l.lag, sum(a.x * b.x) AS p FROM c a JOIN l ON true JOIN c b ON a.key = b.key AND b.t = a.t - l.lag GROUP BY 1, 2), r AS (SELECT q.key, n, l.lag AS lag, (coalesce(p, 0) / ss) ** 2 AS r2 FROM q JOIN l ON true LEFT JOIN p ON p.key = q.key AND p.lag = l.lag WHERE ss > 0), z AS (SELECT key, any_value(n) AS n, any_value(n) * sum(r2) AS bp, any_value(n) * (any_value(n) + 2) * sum(CASE WHEN n > lag THEN r2 / (n - lag) END) AS lb FROM r GROUP BY 1)"
query("ljung_box", f"WITH {_LB} SELECT key, n, CAST(3 AS BIGINT) AS lags, round(bp, 6) AS box_pierce, round({chi2_sf('bp', '3')}, 6) AS p_box_pierce, round(lb, 6) AS ljung_box, round({chi2_sf('lb', '3')}, 6) AS p_ljung_box FROM z")(lambda spark, d: H.portmanteau(T.acf(_events(spark, d), "user_id", _ORDER, "value", 3)))
query("box_pierce", f"WITH {_LB} SELECT key, round(bp, 6) AS box_pierce, round({chi2_sf('bp', '3')}, 6) AS p_box_pierce FROM z")(lambda spark, d: H.portmanteau(T.acf(_events(spark, d), "user_id", _ORDER, "value", 3)).select("key", "box_pierce", "p_box_pierce"))
_OS = _SERIES + ", x AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM s WINDOW w AS (PARTITION BY key ORDER BY t)), a AS (SELECT key, count(*) AS n, count(*) FILTER (v > p) AS up, count(*) FILTER ((v > p AND v > q) OR (v < p AND v < q)) AS tp FROM x GROUP BY 1 HAVING count(*) > 2), z AS (SELECT key, n, (tp - 2 * (n - 2) / 3) / sqrt((16 * n - 29) / 90) AS zt, (up - (n - 1) / 2) / sqrt((n + 1) / 12) AS zd FROM (SELECT key, n::DOUBLE AS n, up, tp FROM a))"
query("turning_point_test", f"WITH {_OS} SELECT key, CAST(n AS BIGINT) AS n, round(zt, 6) AS z_turning_point, round({normal_two_sided('zt')}, 6) AS p_turning_point FROM z")(lambda spark, d: H.order_tests(T.order_statistics(_events(spark, d), "user_id", _ORDER, "value")).select("key", "n", "z_turning_point", "p_turning_point"))
query("difference_sign", f"WITH {_OS} SELECT key, CAST(n AS BIGINT) AS n, round(zd, 6) AS z_difference_sign, round({normal_two_sided('zd')}, 6) AS p_difference_sign FROM z")(lambda spark, d: H.order_tests(T.order_statistics(_events(spark, d), "user_id", _ORDER, "value")).select("key", "n", "z_difference_sign", "p_difference_sign"))
query("runs_test", f"WITH {_SERIES}, h AS (SELECT key, quantile_cont(v, 0.5) AS md FROM s GROUP BY 1), u AS (SELECT key, t, v > md AS up FROM s JOIN h USING (key) WHERE v <> md), n AS (SELECT *, CASE WHEN up IS DISTINCT FROM lag(up) OVER (PARTITION BY key ORDER BY t) THEN 1 ELSE 0 END AS new FROM u), r AS (SELECT key, sum(new) AS runs, count(*) FILTER (up)::DOUBLE AS a, count(*) FILTER (NOT up)::DOUBLE AS b FROM n GROUP BY 1), z AS (SELECT *, a + b AS n, CASE WHEN a + b > 1 AND 2 * a * b > a + b THEN (runs - 2 * a * b / (a + b) - 1) / sqrt(2 * a * b * (2 * a * b - a - b) / ((a + b) ** 2 * (a + b - 1))) END AS z FROM r) SELECT key, CAST(runs AS BIGINT) AS runs, CAST(a AS BIGINT) AS above, CAST(b AS BIGINT) AS below, round(z, 6) AS z, CASE WHEN z IS NOT NULL THEN round({normal_two_sided('z')}, 6) END AS p FROM z")(lambda spark, d: H.runs_test(_events(spark, d), "user_id", _ORDER, "value"))
_half = lambda i, n: f"exp({choose(n, i)} - ({n}) * ln(2.0::DOUBLE))"
query("cox_stuart", f"WITH {_SERIES}, c AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM s), p AS (SELECT a.key, b.v > a.v AS up, b.v < a.v AS down FROM c a JOIN c b ON a.key = b.key AND a.t <= a.n // 2 AND b.t = a.t + (a.n - a.n // 2)), q AS (SELECT key, count(*) FILTER (up) AS above, count(*) FILTER (down) AS below FROM p GROUP BY 1) SELECT key, above, below, round(least(1, list_sum(list_transform(range(0, above + below + 1), lambda i: CASE WHEN {_half('i', '(above + below)')} <= {_half('above', '(above + below)')} * (1 + 1e-7::DOUBLE) THEN {_half('i', '(above + below)')} ELSE 0 END))), 6) AS p FROM q")(lambda spark, d: H.cox_stuart(_events(spark, d), "user_id", _ORDER, "value"))
query("bartels_rank", f"WITH {_SERIES}, r AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY v) + (count(*) OVER (PARTITION BY key, v) - 1) / 2.0::DOUBLE AS r FROM s), e AS (SELECT key, r, r - lag(r) OVER (PARTITION BY key ORDER BY t) AS d, avg(r) OVER (PARTITION BY key) AS m FROM r), u AS (SELECT key, count(*)::DOUBLE AS n, sum(d * d) / sum((r - m) ** 2) AS ratio FROM e GROUP BY 1 HAVING count(*) > 2), z AS (SELECT *, (ratio - 2) / sqrt(4 * (n - 2) * (5 * n * n - 2 * n - 9) / (5 * n * (n + 1) * (n - 1) ** 2)) AS z FROM u) SELECT key, CAST(n AS BIGINT) AS n, round(ratio, 6) AS ratio, round(z, 6) AS z, round({normal_two_sided('z')}, 6) AS p FROM z")(lambda spark, d: H.bartels(_events(spark, d), "user_id", _ORDER, "value"))
query("cusum_chart", f"WITH {_SERIES}, m AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY key ORDER BY t)) AS r FROM s), c AS (SELECT key, avg(v) AS center, avg(r) / 1.128::DOUBLE AS std_dev FROM m GROUP BY 1 HAVING count(*) >= 3 AND avg(r) > 0), z AS (SELECT key, t, center, std_dev, (v - center) / std_dev AS z FROM s JOIN c USING (key)), a AS (SELECT *, sum(z - 0.5) OVER w AS u, sum(-z - 0.5) OVER w AS o FROM z WINDOW w AS (PARTITION BY key ORDER BY t)), b AS (SELECT *, u - least(0, min(u) OVER w) AS up, o - least(0, min(o) OVER w) AS down FROM a WINDOW w AS (PARTITION BY key ORDER BY t)) SELECT key, t, round(up, 5) AS cusum_pos, round(-down, 5) AS cusum_neg, round(center, 5) AS center, round(std_dev, 5) AS std_dev, up > 5 OR down > 5 AS out_of_control FROM b", 5)(lambda spark, d: H.cusum(_events(spark, d), "user_id", _ORDER, "value").withColumn("t", F.col("t").cast("long")))

# outliers and effects
query("grubbs_test", f"WITH {_ROWS}, s AS (SELECT brand, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, max(x) AS hi, min(x) AS lo FROM pr GROUP BY 1), g AS (SELECT brand, n, n::DOUBLE AS c, greatest(hi - m, m - lo) / sd AS g FROM s), t AS (SELECT *, c - 2 AS df, sqrt(c * (c - 2) * g ** 2 / ((c - 1) ** 2 - c * g ** 2)) AS t FROM g) SELECT brand, n, round(g, 5) AS g, round(least(1, c * {t_two_sided('t', 'df')}), 5) AS p FROM t", 5)(lambda spark, d: H.grubbs(_rows(spark, d), ["brand"], "x"))
query("chisq_out_test", f"WITH {_ROWS}, s AS (SELECT brand, greatest(max(x) - avg(x), avg(x) - min(x)) ** 2 / var_samp(x) AS c FROM pr GROUP BY 1) SELECT brand, round(c, 6) AS chi2, round({chi2_sf('c', '1')}, 6) AS p FROM s")(lambda spark, d: H.chi_square_outlier(_rows(spark, d), ["brand"], "x"))
query("fisher_combined", f"WITH {PVALUES}, s AS (SELECT key % 400 AS k, -2 * sum(ln(p)) AS c, 2 * count(*) AS df FROM pv GROUP BY 1) SELECT k, round(c, 6) AS chi2, df, round({chi2_sf('c', 'df')}, 6) AS p FROM s WHERE df < 100")(lambda spark, d: H.fisher_combined(pvalues(spark, d).withColumn("k", F.col("key") % 400), ["k"], "p").where("df < 100"))
_KS = _ROWS + ", v AS (SELECT brand, q, count(*) FILTER (g = 'A') AS a, count(*) FILTER (g = 'R') AS b FROM pr WHERE g IN ('A', 'R') GROUP BY 1, 2), e AS (SELECT brand, sum(a) OVER o AS na, sum(b) OVER o AS nb, abs(sum(a) OVER w::DOUBLE / sum(a) OVER o - sum(b) OVER w::DOUBLE / sum(b) OVER o) AS d FROM v WINDOW w AS (PARTITION BY brand ORDER BY q), o AS (PARTITION BY brand)), s AS (SELECT brand, max(na)::DOUBLE AS na, max(nb)::DOUBLE AS nb, max(d) AS d FROM e GROUP BY 1), z AS (SELECT *, d * d * na * nb / (na + nb) AS x FROM s)"
query("ks_2samp", f"WITH {_KS} SELECT brand, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, round(d, 6) AS d, round(CASE WHEN x < 0.04 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: (-1) ** (j - 1) * 2 * exp(-2 * j * j * x))))) END, 6) AS p FROM z")(lambda spark, d: H.kolmogorov_smirnov(_rows(spark, d), ["brand"], "g", "q", "A", "R"))
query("gwas_inflation", f"WITH {_ROWS}, z AS (SELECT brand, g, ((x - avg(x) OVER w) / stddev_pop(x) OVER w) ** 2 AS c FROM pr WINDOW w AS (PARTITION BY brand)) SELECT brand, round(quantile_cont(c, 0.5) / 0.4549364231195724, 6) AS lambda, count(*) AS n FROM z GROUP BY 1".replace("AS lambda", 'AS "lambda"'))(lambda spark, d: _inflation(spark, d))
query("brier_score", f"WITH {SCORED}, s AS (SELECT count(*) AS n, avg((risk - quality) ** 2) AS b, var_pop(quality) AS r FROM scored) SELECT n, round(b, 6) AS brier, round(r, 6) AS reference, round(1 - b / r, 6) AS skill FROM s")(lambda spark, d: H.brier(scored(spark, d), "quality", "risk"))


def _inflation(spark, d):
    rows = _rows(spark, d)
    s = rows.groupBy("brand").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return H.genomic_inflation(rows.join(F.broadcast(s), "brand").withColumn("c", ((F.col("x") - F.col("m")) / F.col("s")) ** 2), ["brand"], "c")

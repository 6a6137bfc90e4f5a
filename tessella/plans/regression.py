"""Queries over linear and generalised linear models; the SQL uses closed forms of one or two regressors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import regression as R
from tessella.plans.core import rounded
from tessella.plans.fixtures import table
from tessella.plans.tails import chi2_sf, f_sf, normal_two_sided, t_two_sided

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql, places=6):
    def add(f):
        QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
        SQL[name] = sql
        return f

    return add


# customers: orders x, balance z in thousands, spending y in millions, group g
_CUST = "cu AS (SELECT c_custkey AS k, count(*)::DOUBLE AS x, any_value(c_acctbal) / 1000 AS z, sum(o_totalprice) / 1e6::DOUBLE AS y, c_custkey % 2 AS g FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)"


def _cust(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("x"), (F.sum("o_totalprice") / 1e6).alias("y"))
    return t.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("k"), "x", (F.col("c_acctbal") / 1000).alias("z"), "y", (F.col("c_custkey") % 2).alias("g"))


_FIT = _CUST + ", m AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS rss FROM cu)"
query("regress", f"WITH {_FIT}, s AS (SELECT 'intercept' AS term, a AS estimate, sqrt(rss / (n - 2) * (1 / n::DOUBLE + mx * mx / sxx)) AS std_error, n - 2 AS df FROM m UNION ALL SELECT 'x', b, sqrt(rss / (n - 2) / sxx), n - 2 FROM m), t AS (SELECT *, estimate / std_error AS t FROM s) SELECT term, round(estimate, 5) AS estimate, round(std_error, 5) AS std_error, df, round(t, 5) AS t, round({t_two_sided('t', 'df')}, 5) AS p FROM t", 5)(lambda spark, d: R.regress(_cust(spark, d), "y", ["x"]))
_INF = _FIT + ", e AS (SELECT k AS key, y - a - b * x AS e, 1 / n::DOUBLE + (x - mx) ** 2 / sxx AS h, x - mx AS c, n, rss, sxx FROM cu, m), s AS (SELECT *, (rss - e * e / (1 - h)) / (n - 3) AS s2 FROM e), i AS (SELECT key, e AS residual, h AS leverage, e / sqrt(rss / (n - 2) * (1 - h)) AS standardized, e / sqrt(s2 * (1 - h)) AS studentized, e / (1 - h) AS press_residual, c / sxx * e / (1 - h) / sqrt(s2 / sxx) AS dfbetas_x, n, h FROM s)"
_influence = lambda spark, d: R.influence(_cust(spark, d), "k", "y", ["x"])
for _name, _sql, _columns in [
    ("leverage", "round(leverage, 6) AS leverage", ["leverage"]),
    ("standardized_residuals", "round(standardized, 6) AS standardized", ["standardized"]),
    ("studentized_residuals", "round(studentized, 6) AS studentized", ["studentized"]),
    ("cooks_distance", "round(standardized ** 2 * h / (1 - h) / 2, 6) AS cooks_distance", ["cooks_distance"]),
    ("dffits", "round(studentized * sqrt(h / (1 - h)), 6) AS dffits", ["dffits"]),
    ("covratio", "round(1 / ((1 - h) * ((n - 3 + studentized ** 2) / (n - 2)) ** 2), 6) AS covratio", ["covratio"]),
    ("dfbetas", "round(dfbetas_x, 6) AS dfbetas_x", ["dfbetas_x"]),
]:
    query(_name, f"WITH {_INF} SELECT key, {_sql} FROM i")(lambda spark, d, c=tuple(_columns): _influence(spark, d).select("key", *c))
query("press", f"WITH {_INF} SELECT round(sum(press_residual ** 2), 6) AS press, count(*) AS n FROM i")(lambda spark, d: _influence(spark, d).agg(F.sum(F.col("press_residual") ** 2).alias("press"), F.count(F.lit(1)).alias("n")))
_E2 = _FIT + ", e AS (SELECT x, x * x AS x2, (y - a - b * x) ** 2 AS e2 FROM cu, m)"
query("breusch_pagan", f"WITH {_E2}, q AS (SELECT count(*) * corr(e2, x) ** 2 AS c FROM e) SELECT round(c, 5) AS chi2, CAST(1 AS BIGINT) AS df, round({chi2_sf('c', '1')}, 5) AS p FROM q", 5)(lambda spark, d: R.breusch_pagan(_cust(spark, d), "y", ["x"]))
_R2 = lambda y, a, b: f"(corr({y}, {a}) ** 2 + corr({y}, {b}) ** 2 - 2 * corr({y}, {a}) * corr({y}, {b}) * corr({a}, {b})) / (1 - corr({a}, {b}) ** 2)"
query("white_test", f"WITH {_E2}, q AS (SELECT count(*) * {_R2('e2', 'x', 'x2')} AS c FROM e) SELECT round(c, 5) AS chi2, CAST(2 AS BIGINT) AS df, round({chi2_sf('c', '2')}, 5) AS p FROM q", 5)(lambda spark, d: R.white(_cust(spark, d), "y", ["x"]))
query("reset_test", f"WITH {_CUST}, s AS (SELECT x, x * x AS x2, y FROM cu), q AS (SELECT count(*) - 3 AS df2, corr(y, x) ** 2 AS r1, {_R2('y', 'x', 'x2')} AS r2 FROM s), f AS (SELECT (r2 - r1) / ((1 - r2) / df2) AS f, CAST(1 AS BIGINT) AS df1, df2 FROM q) SELECT round(f, 4) AS f, df1, df2, round({f_sf('f', 'df1', 'df2')}, 4) AS p FROM f", 4)(lambda spark, d: R.reset(_cust(spark, d), "y", ["x"]))
_RSS = "regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)"
query("chow_test", f"WITH {_CUST}, w AS (SELECT {_RSS} AS r, count(*) AS n FROM cu), p AS (SELECT sum(r) AS r FROM (SELECT {_RSS} AS r FROM cu GROUP BY g)), f AS (SELECT (w.r - p.r) / 2 / (p.r / (n - 4)) AS f, CAST(2 AS BIGINT) AS df1, n - 4 AS df2 FROM w, p) SELECT round(f, 5) AS f, df1, df2, round({f_sf('f', 'df1', 'df2')}, 5) AS p FROM f", 5)(lambda spark, d: R.chow(_cust(spark, d), "y", ["x"], "g", 0, 1))
query("vif", f"WITH {_CUST}, v AS (SELECT 1 / (1 - corr(x, z) ** 2) AS v FROM cu) SELECT unnest(['x', 'z']) AS term, round(v, 6) AS vif FROM v")(lambda spark, d: R.vif(_cust(spark, d), ["x", "z"]))
query("partial_correlation", f"WITH {_CUST}, c AS (SELECT (corr(x, y) - corr(x, z) * corr(y, z)) / sqrt((1 - corr(x, z) ** 2) * (1 - corr(y, z) ** 2)) AS r, count(*) - 3 AS df FROM cu), t AS (SELECT r, r * sqrt(df / (1 - r * r)) AS t, df FROM c) SELECT round(r, 5) AS r, round(t, 5) AS t, df, round({t_two_sided('t', 'df')}, 5) AS p FROM t", 5)(lambda spark, d: R.partial_correlation(_cust(spark, d), "x", "y", ["z"]))
query("pearson_test", f"WITH {_CUST}, c AS (SELECT g, corr(z, y) AS r, count(*) AS n FROM cu GROUP BY 1), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c) SELECT g, round(r, 6) AS r, n, round(t, 6) AS t, round({t_two_sided('t', 'n - 2')}, 6) AS p FROM t")(lambda spark, d: R.pearson_test(_cust(spark, d), ["g"], "z", "y"))
query("mahalanobis_distance", f"WITH {_CUST}, m AS (SELECT avg(x) AS mx, avg(z) AS mz, var_samp(x) AS a, var_samp(z) AS b, covar_samp(x, z) AS c FROM cu), q AS (SELECT k AS key, (b * (x - mx) ** 2 - 2 * c * (x - mx) * (z - mz) + a * (z - mz) ** 2) / (a * b - c * c) AS d FROM cu, m) SELECT key, round(d, 6) AS distance2, round({chi2_sf('d', '2')}, 6) AS p FROM q")(lambda spark, d: R.mahalanobis(_cust(spark, d), "k", ["x", "z"]))
_PCA = _CUST + ", h AS (SELECT k, CASE WHEN k % 7 <> 0 THEN x END AS x, z, y FROM cu), m AS (SELECT avg(x) AS mx, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(z) AS sz FROM h), s AS (SELECT k, coalesce((x - mx) / sx, 0) AS x, (z - mz) / sz AS z FROM h, m), g AS (SELECT sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS c FROM s), e AS (SELECT a, b, a + c AS t, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM g), v AS (SELECT 1 AS component, b / sqrt(b * b + (l1 - a) ** 2) AS p, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS q, l1 / t AS share FROM e UNION ALL SELECT 2, b / sqrt(b * b + (l2 - a) ** 2), (l2 - a) / sqrt(b * b + (l2 - a) ** 2), l2 / t FROM e)"
query("pca", f"WITH {_PCA} SELECT k AS key, component, round((x * p + z * q) * sign(CASE WHEN abs(p) >= abs(q) * (1 - 1e-9) THEN p ELSE q END), 5) AS score, round(share, 5) AS share FROM s, v", 5)(lambda spark, d: R.pca(_cust(spark, d).withColumn("x", F.when(F.col("k") % 7 != 0, F.col("x"))), "k", ["x", "z"]))
_COR = _CUST + ", r AS (SELECT count(*) AS n, corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c FROM cu)"
query("bartlett_sphericity", f"WITH {_COR}, q AS (SELECT -(n - 1 - 11 / 6.0::DOUBLE) * ln(1 + 2 * a * b * c - a * a - b * b - c * c) AS c FROM r) SELECT round(c, 5) AS chi2, CAST(3 AS BIGINT) AS df, round({chi2_sf('c', '3')}, 5) AS p FROM q", 5)(lambda spark, d: R.sphericity(_cust(spark, d), ["x", "y", "z"]).drop("kmo"))
query("kmo_test", f"WITH {_COR}, p AS (SELECT a * a + b * b + c * c AS r2, (a - b * c) ** 2 / ((1 - b * b) * (1 - c * c)) + (b - a * c) ** 2 / ((1 - a * a) * (1 - c * c)) + (c - a * b) ** 2 / ((1 - a * a) * (1 - b * b)) AS q2 FROM r) SELECT round(r2 / (r2 + q2), 6) AS kmo FROM p")(lambda spark, d: R.sphericity(_cust(spark, d), ["x", "y", "z"]).select("kmo"))
_COV = _CUST + ", s AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, var_samp(x) AS a, var_samp(z) AS b, covar_samp(x, z) AS c FROM cu GROUP BY 1), w AS (SELECT sum(n) AS n, sum((n - 1) * a) / (sum(n) - 2) AS a, sum((n - 1) * b) / (sum(n) - 2) AS b, sum((n - 1) * c) / (sum(n) - 2) AS c, max(n) FILTER (g = 0) AS na, max(n) FILTER (g = 1) AS nb, max(mx) FILTER (g = 0) - max(mx) FILTER (g = 1) AS dx, max(mz) FILTER (g = 0) - max(mz) FILTER (g = 1) AS dz FROM s)"
query("hotelling_t2", f"WITH {_COV}, t AS (SELECT na * nb / n * (b * dx * dx - 2 * c * dx * dz + a * dz * dz) / (a * b - c * c) AS t2, n FROM w), f AS (SELECT t2, t2 * (n - 3) / (2 * (n - 2)) AS f, CAST(2 AS BIGINT) AS df1, CAST(n - 3 AS BIGINT) AS df2 FROM t) SELECT round(t2, 5) AS t2, round(f, 5) AS f, df1, df2, round({f_sf('f', 'df1', 'df2')}, 5) AS p FROM f", 5)(lambda spark, d: R.hotelling(_cust(spark, d), ["x", "z"], "g", 0, 1))
query("box_m", f"WITH {_COV}, l AS (SELECT sum((n - 1) * ln(a * b - c * c)) AS l, sum(1 / (n - 1)) AS i FROM s), q AS (SELECT ((w.n - 2) * ln(a * b - c * c) - l) * (1 - (i - 1 / (w.n - 2)) * 13 / 18.0::DOUBLE) AS c FROM w, l) SELECT round(c, 5) AS chi2, CAST(3 AS BIGINT) AS df, round({chi2_sf('c', '3')}, 5) AS p FROM q", 5)(lambda spark, d: R.box_m(_cust(spark, d), ["x", "z"], "g", [0, 1]))
query("deming_regression", f"WITH {_CUST}, s AS (SELECT g, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c, avg(x) AS mx, avg(y) AS my FROM cu GROUP BY 1), t AS (SELECT *, (b - a + sqrt((b - a) ** 2 + 4 * c * c)) / (2 * c) AS l FROM s) SELECT g, round(l, 6) AS slope, round(my - l * mx, 6) AS intercept FROM t")(lambda spark, d: R.deming(_cust(spark, d), ["g"], "x", "y"))

# studies: one brand each, its effect and standard error
_STUDY = "st AS (SELECT p_brand AS k, avg(p_retailprice) / 100 AS e, stddev_samp(p_retailprice) / sqrt(count(*)) / 100 AS s FROM part GROUP BY 1)"


def _egger(spark, d):
    v = F.col("p_retailprice")
    t = table(spark, d, "part").groupBy("p_brand").agg((F.avg(v) / 100).alias("e"), (F.stddev_samp(v) / F.sqrt(F.count(v)) / 100).alias("s"))
    return R.regress(t.select((F.col("e") / F.col("s")).alias("y"), (1 / F.col("s")).alias("x")), "y", ["x"]).where("term = 'intercept'").drop("term")


query("egger_test", f"WITH {_STUDY}, cu AS (SELECT e / s AS y, 1 / s AS x FROM st), m AS (SELECT count(*) AS n, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, {_RSS} AS rss FROM cu), t AS (SELECT a AS estimate, sqrt(rss / (n - 2) * (1 / n::DOUBLE + mx * mx / sxx)) AS std_error, n - 2 AS df FROM m), u AS (SELECT *, estimate / std_error AS t FROM t) SELECT round(estimate, 5) AS estimate, round(std_error, 5) AS std_error, df, round(t, 5) AS t, round({t_two_sided('t', 'df')}, 5) AS p FROM u", 5)(lambda spark, d: _egger(spark, d))


# generalised models of a two-valued regressor, whose estimates SQL has in closed form
def _lines(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_linenumber") == 1).cast("int").alias("x"), "l_linenumber", "l_quantity")


def _closed(cte: str) -> str:
    return f"WITH {cte}, t AS (SELECT 'intercept' AS term, b0 AS estimate, s0 AS std_error FROM q UNION ALL SELECT 'x', b1, s1 FROM q), z AS (SELECT *, estimate / std_error AS z FROM t) SELECT term, round(estimate, 5) AS estimate, round(std_error, 5) AS std_error, round(z, 4) AS z, round({normal_two_sided('z')}, 4) AS p FROM z"


_LINES = "li AS (SELECT CAST(l_returnflag = 'R' AS INT) AS r, CAST(l_linenumber = 1 AS INT) AS x, l_linenumber AS c, l_quantity AS v FROM lineitem)"
_glm = lambda t: t.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"), F.round("z", 4).alias("z"), F.round("p", 4).alias("p"))
query("logistic_regression", _closed(_LINES + ", n AS (SELECT count(*) FILTER (x = 1 AND r = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND r = 0)::DOUBLE AS b, count(*) FILTER (x = 0 AND r = 1)::DOUBLE AS c, count(*) FILTER (x = 0 AND r = 0)::DOUBLE AS d FROM li), q AS (SELECT ln(c / d) AS b0, sqrt(1 / c + 1 / d) AS s0, ln(a * d / (b * c)) AS b1, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS s1 FROM n)"))(lambda spark, d: _glm(R.glm(_lines(spark, d), "r", ["x"])))
query("poisson_regression", _closed(_LINES + ", n AS (SELECT sum(c) FILTER (r = 1)::DOUBLE AS a, avg(c) FILTER (r = 1) AS ma, sum(c) FILTER (r = 0)::DOUBLE AS b, avg(c) FILTER (r = 0) AS mb FROM li), q AS (SELECT ln(mb) AS b0, sqrt(1 / b) AS s0, ln(ma / mb) AS b1, sqrt(1 / a + 1 / b) AS s1 FROM n)"))(lambda spark, d: _glm(R.glm(_lines(spark, d).withColumnRenamed("x", "_x").withColumnRenamed("r", "x"), "l_linenumber", ["x"], "poisson")))
query("gamma_regression", _closed(_LINES + ", n AS (SELECT r, count(*)::DOUBLE AS n, avg(v) AS m, sum(v * v) AS v2 FROM li GROUP BY 1), p AS (SELECT sum(v2 / m ** 2 - n) / (sum(n) - 2) AS phi, max(m) FILTER (r = 1) AS ma, max(m) FILTER (r = 0) AS mb, max(n) FILTER (r = 1) AS na, max(n) FILTER (r = 0) AS nb FROM n), q AS (SELECT ln(mb) AS b0, sqrt(phi / nb) AS s0, ln(ma / mb) AS b1, sqrt(phi * (1 / na + 1 / nb)) AS s1 FROM p)"))(lambda spark, d: _glm(R.glm(_lines(spark, d).withColumnRenamed("x", "_x").withColumnRenamed("r", "x"), "l_quantity", ["x"], "gamma")))

"""Queries over rank tests, agreement of raters and tests along a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import contingency as C
from tessella.operators import groups as G
from tessella.operators import hypotheses as H
from tessella.operators import ranks as R
from tessella.operators import series as T
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, SCORED, cells, scored, table
from tessella.plans.hypotheses import _ROWS, _SERIES, _rows
from tessella.plans.tails import chi2_sf, f_sf, normal_two_sided

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql, places=6):
    def add(f):
        QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
        SQL[name] = sql
        return f

    return add


_U = _ROWS + ", w AS (SELECT brand, g, q, rank() OVER (PARTITION BY brand ORDER BY q) + (count(*) OVER (PARTITION BY brand, q) - 1) / 2.0::DOUBLE AS r FROM pr WHERE g IN ('A', 'R')), u AS (SELECT brand, (2 * (sum(r) FILTER (g = 'A') - count(*) FILTER (g = 'A') * (count(*) FILTER (g = 'A') + 1) / 2.0::DOUBLE) / (count(*) FILTER (g = 'A') * count(*) FILTER (g = 'R')::DOUBLE) - 1) AS d FROM w GROUP BY 1)"
for _name in ("rank_biserial", "cliffs_delta"):
    query(_name, f"WITH {_U} SELECT brand, round(d, 6) AS {_name} FROM u")(lambda spark, d, n=_name: G.mann_whitney(_rows(spark, d), ["brand"], "g", "q", "A", "R").select("brand", F.col("cliffs_delta").alias(n)))
_GROUPS = ["N", "A", "R"]
_JT = _ROWS + ", o AS (SELECT brand, CASE g WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS g, q, count(*)::DOUBLE AS c FROM pr GROUP BY 1, 2, 3), j AS (SELECT a.brand, sum(a.c * b.c * CASE WHEN a.q < b.q THEN 1 WHEN a.q = b.q THEN 0.5 ELSE 0 END) AS j FROM o a JOIN o b ON a.brand = b.brand AND a.g < b.g GROUP BY 1), t AS (SELECT brand, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS t1, sum(t * (t - 1) * (t - 2)) AS t2, sum(t * (t - 1)) AS t3 FROM (SELECT brand, q, sum(c) AS t FROM o GROUP BY 1, 2) GROUP BY 1), m AS (SELECT brand, sum(m * m) AS m0, sum(m * (m - 1) * (2 * m + 5)) AS m1, sum(m * (m - 1) * (m - 2)) AS m2, sum(m * (m - 1)) AS m3 FROM (SELECT brand, g, sum(c) AS m FROM o GROUP BY 1, 2) GROUP BY 1), z AS (SELECT brand, j, n, (j - (n * n - m0) / 4) / sqrt((n * (n - 1) * (2 * n + 5) - m1 - t1) / 72 + m2 * t2 / (36 * n * (n - 1) * (n - 2)) + m3 * t3 / (8 * n * (n - 1))) AS z FROM j JOIN t USING (brand) JOIN m USING (brand))"
query("jonckheere_terpstra", f"WITH {_JT} SELECT brand, CAST(j AS DOUBLE) AS j, CAST(n AS BIGINT) AS n, round(z, 6) AS z, round({normal_two_sided('z')}, 6) AS p FROM z")(lambda spark, d: R.jonckheere(_rows(spark, d), ["brand"], "g", "q", _GROUPS))
_AB = _ROWS + ", w AS (SELECT brand, g, rank() OVER (PARTITION BY brand ORDER BY q) + (count(*) OVER (PARTITION BY brand, q) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY brand)::DOUBLE AS n FROM pr WHERE g IN ('A', 'R')), s AS (SELECT brand, n, count(*) FILTER (g = 'A')::DOUBLE AS m, sum(least(r, n + 1 - r)) FILTER (g = 'A') AS ab, sum(least(r, n + 1 - r) ** 2) AS q FROM w GROUP BY 1, 2), z AS (SELECT brand, ab, CASE WHEN n % 2 = 0 THEN (ab - m * (n + 2) / 4) / sqrt(m * (n - m) * (16 * q - n * (n + 2) ** 2) / (16 * n * (n - 1))) ELSE (ab - m * (n + 1) ** 2 / (4 * n)) / sqrt(m * (n - m) * (16 * n * q - (n + 1) ** 4) / (16 * n * n * (n - 1))) END AS z FROM s)"
query("ansari_bradley", f"WITH {_AB} SELECT brand, round(ab, 6) AS ab, round(z, 6) AS z, round({normal_two_sided('z')}, 6) AS p FROM z")(lambda spark, d: R.ansari_bradley(_rows(spark, d), ["brand"], "g", "q", "A", "R"))
_FULL = CELLS + ", f AS (SELECT *, count(*) OVER (PARTITION BY part) AS c FROM cells), x AS (SELECT part, flag, value FROM f WHERE c = 3)"
query("quade_test", f"WITH {_FULL}, g AS (SELECT part, max(value) - min(value) AS s FROM x GROUP BY 1), q AS (SELECT part, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS q FROM g), r AS (SELECT flag, q * (rank() OVER (PARTITION BY part ORDER BY value) + (count(*) OVER (PARTITION BY part, value) - 1) / 2.0::DOUBLE - 2) AS s FROM x JOIN q USING (part)), t AS (SELECT flag, sum(s) AS s, sum(s * s) AS a, count(*)::DOUBLE AS b FROM r GROUP BY 1), u AS (SELECT sum(a) AS a, sum(s * s / b) AS w, max(b) AS b FROM t), z AS (SELECT (b - 1) * w / (a - w) AS f, CAST(2 AS BIGINT) AS df1, CAST((b - 1) * 2 AS BIGINT) AS df2 FROM u) SELECT round(f, 6) AS f, df1, df2, round({f_sf('f', 'df1', 'df2')}, 6) AS p FROM z")(lambda spark, d: R.quade(cells(spark, d), "part", "flag", "value", 3))
_KA = _FULL + ", v AS (SELECT part AS u, CAST(value AS BIGINT) % 4 AS v FROM cells), t AS (SELECT u, v, count(*)::DOUBLE AS c FROM v GROUP BY 1, 2), m AS (SELECT u, sum(c) AS m, sum(c * c) AS c2, sum(c * v) AS s, sum(c * v * v) AS s2 FROM t GROUP BY 1 HAVING sum(c) > 1), w AS (SELECT v, sum(c) AS c FROM t WHERE u IN (SELECT u FROM m) GROUP BY 1)"
_raters = lambda spark, d: cells(spark, d).withColumn("v", F.col("value").cast("long") % 4)
query("krippendorff_alpha", f"WITH {_KA} SELECT round(1 - (max(n) - 1) * sum(i) / max(o), 6) AS alpha, count(*) AS units, CAST(max(n) AS BIGINT) AS n FROM (SELECT (m * m - c2) / (m - 1) AS i FROM m), (SELECT sum(c) AS n, sum(c) ** 2 - sum(c * c) AS o FROM w)")(lambda spark, d: R.krippendorff(_raters(spark, d), "part", "v"))
query("krippendorff_alpha_interval", f"WITH {_KA} SELECT round(1 - (max(n) - 1) * sum(i) / max(o), 6) AS alpha, count(*) AS units, CAST(max(n) AS BIGINT) AS n FROM (SELECT 2 * (m * s2 - s * s) / (m - 1) AS i FROM m), (SELECT sum(c) AS n, 2 * (sum(c) * sum(c * v * v) - sum(c * v) ** 2) AS o FROM w)")(lambda spark, d: R.krippendorff(_raters(spark, d), "part", "v", "interval"))
query("intraclass_correlation", f"WITH {_FULL}, g AS (SELECT avg(value) AS g FROM x), r AS (SELECT sum((m - g) ** 2) * 3 AS ssr, count(*)::DOUBLE AS n FROM (SELECT avg(value) AS m FROM x GROUP BY part), g), c AS (SELECT sum((m - g) ** 2) AS s FROM (SELECT avg(value) AS m FROM x GROUP BY flag), g), t AS (SELECT sum((value - g) ** 2) AS sst FROM x, g), q AS (SELECT n, ssr / (n - 1) AS r, n * s / 2 AS c, (sst - ssr - n * s) / ((n - 1) * 2) AS e, (sst - ssr) / (n * 2) AS w FROM r, c, t) SELECT CAST(n AS BIGINT) AS n, round((r - w) / (r + 2 * w), 6) AS oneway_single, round((r - w) / r, 6) AS oneway_average, round((r - e) / (r + 2 * e + 3 / n * (c - e)), 6) AS agreement_single, round((r - e) / (r + (c - e) / n), 6) AS agreement_average, round((r - e) / (r + 2 * e), 6) AS consistency_single, round((r - e) / r, 6) AS consistency_average FROM q")(lambda spark, d: R.intraclass(cells(spark, d), "part", "flag", "value", 3))
_RC = SCORED + ", s AS (SELECT quality = 1 AS y, least(score, 3000) / 3001.0::DOUBLE - risk AS d FROM scored)"
_new = lambda spark, d: scored(spark, d).withColumn("new", F.least(F.col("score"), F.lit(3000.0)) / 3001.0)
query("integrated_discrimination_improvement", f"WITH {_RC} SELECT round(avg(d) FILTER (y) - avg(d) FILTER (NOT y), 6) AS idi, count(*) AS n FROM s")(lambda spark, d: R.reclassification(_new(spark, d), "quality", "risk", "new").select("idi", "n"))
query("net_reclassification_improvement", f"WITH {_RC}, e AS (SELECT avg(sign(d)) FILTER (y) AS a, -avg(sign(d)) FILTER (NOT y) AS b FROM s) SELECT round(a, 6) AS nri_events, round(b, 6) AS nri_others, round(a + b, 6) AS nri FROM e")(lambda spark, d: R.reclassification(_new(spark, d), "quality", "risk", "new").select("nri_events", "nri_others", "nri"))
query("confusion_matrix", f"WITH {SCORED}, p AS (SELECT quality AS actual, CAST(risk > 0.1 AS INT) AS predicted FROM scored), g AS (SELECT * FROM (SELECT unnest([0, 1]) AS actual) CROSS JOIN (SELECT unnest([0, 1]) AS predicted)) SELECT g.actual, g.predicted, count(p.actual) AS n FROM g LEFT JOIN p ON g.actual = p.actual AND g.predicted = p.predicted GROUP BY 1, 2")(lambda spark, d: C.confusion(scored(spark, d).withColumn("predicted", (F.col("risk") > 0.1).cast("int")), "quality", "predicted"))
query("morisita", f"WITH {CELLS}, s AS (SELECT part AS key, sum(value) AS s, sum(value * value) AS s2 FROM cells GROUP BY 1), c AS (SELECT key, 3 * (s2 - s) / (s * s - s) AS i, s2 * 3 / s - s AS c FROM s WHERE s > 1) SELECT key, round(i, 6) AS \"index\", round(c, 6) AS chi2, round({chi2_sf('c', '2')}, 6) AS p FROM c")(lambda spark, d: R.morisita(cells(spark, d), "part", "value", 3).where("index is not null"))
_LAB = "t AS (SELECT p_size % 5 AS a, p_partkey % 4 AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS m FROM t), h AS (SELECT -sum(n / m * ln(n / nb)) AS ab, -sum(n / m * ln(n / na)) AS ba, -sum(n / m * ln(na / m)) AS a, -sum(n / m * ln(nb / m)) AS b, sum(n * n) AS n2, any_value(m) AS m FROM s), r AS (SELECT sum(n * n) AS r2 FROM (SELECT sum(n) AS n FROM t GROUP BY a)), c AS (SELECT sum(n * n) AS c2 FROM (SELECT sum(n) AS n FROM t GROUP BY b))"
_lab = lambda spark, d: C.clustering_scores(table(spark, d, "part").select((F.col("p_size") % 5).alias("a"), (F.col("p_partkey") % 4).alias("b")), "a", "b")
for _name, _sql, _columns in [
    ("homogeneity_completeness_v_measure", "round(1 - ab / a, 6) AS homogeneity, round(1 - ba / b, 6) AS completeness, round(2 * (1 - ab / a) * (1 - ba / b) / (1 - ab / a + 1 - ba / b), 6) AS v_measure", ["homogeneity", "completeness", "v_measure"]),
    ("variation_of_information", "round(ab + ba, 6) AS variation_of_information", ["variation_of_information"]),
    ("fowlkes_mallows", "round((n2 - m) / sqrt((r2 - m) * (c2 - m)), 6) AS fowlkes_mallows", ["fowlkes_mallows"]),
    ("pair_confusion_matrix", "CAST(m * m - r2 - c2 + n2 AS BIGINT) AS apart_apart, CAST(c2 - n2 AS BIGINT) AS apart_together, CAST(r2 - n2 AS BIGINT) AS together_apart, CAST(n2 - m AS BIGINT) AS together_together", ["apart_apart", "apart_together", "together_apart", "together_together"]),
    ("adjusted_rand", "round(((n2 - m) / 2 - (r2 - m) * (c2 - m) / (2 * m * (m - 1))) / ((r2 + c2 - 2 * m) / 4 - (r2 - m) * (c2 - m) / (2 * m * (m - 1))), 6) AS adjusted_rand", ["adjusted_rand"]),
]:
    query(_name, f"WITH {_LAB} SELECT {_sql} FROM h, r, c")(lambda spark, d, c=tuple(_columns): _lab(spark, d).select(*c))

_events = lambda spark, d: table(spark, d, "events")
_ORDER = ["ts", "event_id"]
_PACF = _SERIES + ", c AS (SELECT *, v - avg(v) OVER (PARTITION BY key) AS x FROM s), l AS (SELECT key, x, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c FROM c WINDOW w AS (PARTITION BY key ORDER BY t)), r AS (SELECT key, coalesce(sum(x * a), 0) / sum(x * x) AS a, coalesce(sum(x * b), 0) / sum(x * x) AS b, coalesce(sum(x * c), 0) / sum(x * x) AS c FROM l GROUP BY 1 HAVING count(*) > 5), p AS (SELECT key, a, (b - a * a) / (1 - a * a) AS p2, a * (1 - b) / (1 - a * a) AS p1, b, c FROM r), q AS (SELECT key, unnest([1, 2, 3]) AS lag, unnest([a, p2, (c - p1 * b - p2 * a) / (1 - p1 * a - p2 * b)]) AS pacf FROM p) SELECT key, lag, round(pacf, 6) AS pacf FROM q"
query("pacf", f"WITH {_PACF}")(lambda spark, d: R.partial_acf(T.acf(_events(spark, d), "user_id", _ORDER, "value", 3).where("n > 5"), 3))
query("arch_lm", f"WITH {_SERIES}, e AS (SELECT key, t, (v - avg(v) OVER (PARTITION BY key)) ** 2 AS e FROM s), l AS (SELECT key, e, lag(e) OVER (PARTITION BY key ORDER BY t) AS p FROM e), c AS (SELECT key, count(*) AS n, count(*) * corr(e, p) ** 2 AS c FROM l WHERE p IS NOT NULL GROUP BY 1 HAVING count(*) > 3) SELECT key, round(c, 6) AS chi2, n, round({chi2_sf('c', '1')}, 6) AS p FROM c")(lambda spark, d: R.arch_lm(_events(spark, d), "user_id", _ORDER, "value").where("n > 3"))
query("pettitt_test", f"WITH {_SERIES}, r AS (SELECT *, rank() OVER (PARTITION BY key ORDER BY v) + (count(*) OVER (PARTITION BY key, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY key)::DOUBLE AS n FROM s), u AS (SELECT key, t, n, abs(2 * sum(r) OVER (PARTITION BY key ORDER BY t) - t * (n + 1)) AS u FROM r), k AS (SELECT key, n, max(u) AS k FROM u GROUP BY 1, 2) SELECT key, k, min(t) AS at, round(least(1, 2 * exp(-6 * k * k / (any_value(u.n) ** 3 + any_value(u.n) ** 2))), 6) AS p FROM u JOIN k USING (key) WHERE u.u = k.k GROUP BY key, k".replace("AS at", 'AS "at"'))(lambda spark, d: R.pettitt(_events(spark, d), "user_id", _ORDER, "value"))

"""Queries over repeated measures, clusters, populations and proteins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import clusters as K
from tessella.operators import genetics as N
from tessella.operators import populations as O
from tessella.operators import proteins as R
from tessella.operators import repeated as T
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, DNA, DOSAGES, LIVES, cells, dna, dosages, lives, table
from tessella.plans.tails import chi2_sf, normal_two_sided

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


_FULL = CELLS + ", f AS (SELECT *, count(*) OVER (PARTITION BY part) AS c FROM cells), x AS (SELECT * FROM f WHERE c = 3)"
query("friedman", f"WITH {_FULL}, r AS (SELECT *, count(*) OVER (PARTITION BY part, value) AS t, rank() OVER (PARTITION BY part ORDER BY value) + (count(*) OVER (PARTITION BY part, value) - 1) / 2.0::DOUBLE AS r FROM x), s AS (SELECT flag, sum(r) AS s, count(*)::DOUBLE AS b FROM r GROUP BY 1), g AS (SELECT sum(s * s) AS s2, max(b) AS b FROM s), t AS (SELECT sum(t * t - 1)::DOUBLE AS ties FROM r), q AS (SELECT b, (12 * s2 / (b * 12) - 12 * b) / (1 - ties / (b * 24)) AS chi2 FROM g, t) SELECT round(chi2, 6) AS chi2, round({chi2_sf("chi2", "2")}, 6) AS p, round(chi2 / (b * 2), 6) AS kendall_w, CAST(b AS BIGINT) AS blocks, 3 AS treatments FROM q")(lambda spark, d: T.friedman(cells(spark, d), "part", "flag", "value"))
query("cochran_q", f"WITH {_FULL}, y AS (SELECT part, flag, CAST(value > 100 AS INT) AS v FROM x), g AS (SELECT sum(g::DOUBLE ** 2) AS g2, sum(g)::DOUBLE AS t FROM (SELECT sum(v) AS g FROM y GROUP BY flag)), l AS (SELECT sum(l::DOUBLE ** 2) AS l2 FROM (SELECT sum(v) AS l FROM y GROUP BY part)) SELECT round(2 * (3 * g2 - t * t) / (3 * t - l2), 6) AS q, round({chi2_sf("2 * (3 * g2 - t * t) / (3 * t - l2)", "2")}, 6) AS p FROM g, l")(lambda spark, d: T.cochran_q(cells(spark, d).withColumn("v", (F.col("value") > 100).cast("int")), "part", "flag", "v"))
query("fleiss_kappa", f"WITH {_FULL}, c AS (SELECT part, CAST(value AS BIGINT) % 4 AS k, count(*) AS n FROM x GROUP BY 1, 2), p AS (SELECT avg(s / 6.0::DOUBLE) AS po FROM (SELECT sum(n * (n - 1)) AS s FROM c GROUP BY part)), e AS (SELECT sum((n / t) ** 2) AS pe FROM (SELECT k, sum(n)::DOUBLE AS n, (SELECT sum(n) FROM c)::DOUBLE AS t FROM c GROUP BY 1)) SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM p, e")(lambda spark, d: T.fleiss_kappa(cells(spark, d).join(cells(spark, d).groupBy("part").count().where("count = 3"), "part", "left_semi").groupBy("part", (F.col("value").cast("long") % 4).alias("k")).agg(F.count(F.lit(1)).alias("n")), "part", "k", "n"))
_YEARS = "y AS (SELECT o_orderpriority AS key, date_diff('day', DATE '1992-01-01', CAST(date_trunc('month', o_orderdate) AS DATE)) AS t, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)"


def _months(spark, d):
    day = F.date_diff(F.to_date(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))), F.lit("1992-01-01").cast("date"))
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key"), day.cast("long").alias("t")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))


query("mann_kendall", f"WITH {_YEARS}, s AS (SELECT a.key, sum(sign(b.v - a.v))::DOUBLE AS s FROM y a JOIN y b ON a.key = b.key AND a.t < b.t GROUP BY 1), g AS (SELECT key, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT key, v, count(*)::DOUBLE AS c FROM y GROUP BY 1, 2) GROUP BY 1), z AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS var FROM s JOIN g USING (key)) SELECT key, s, round(2 * s / (n * (n - 1)), 6) AS tau, round(var, 6) AS variance, round((s - sign(s)) / sqrt(var), 6) AS z, round({normal_two_sided("(s - sign(s)) / sqrt(var)")}, 6) AS p FROM z")(lambda spark, d: T.mann_kendall(_months(spark, d), "key", "t", "v"))
query("sen_slope", f"WITH {_YEARS}, p AS (SELECT a.key, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope, count(*) AS pairs FROM y a JOIN y b ON a.key = b.key AND a.t < b.t GROUP BY 1) SELECT key, round(any_value(slope), 5) AS slope, any_value(pairs) AS pairs, round(quantile_cont(v - slope * t, 0.5), 5) AS intercept FROM y JOIN p USING (key) GROUP BY 1", 5)(lambda spark, d: T.sen_slope(_months(spark, d), "key", "t", "v"))
query("mantel_haenszel", "WITH s AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS a, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS b, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS c, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1), t AS (SELECT *, a + b + c + d AS n FROM s), u AS (SELECT sum(a * d / n) AS p, sum(b * c / n) AS q, sum(a - (a + b) * (a + c) / n) AS x, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS v FROM t WHERE n > 1) SELECT CASE WHEN q > 0 THEN round(p / q, 6) END AS odds_ratio, round(x * x / v, 6) AS chi2 FROM u")(lambda spark, d: T.mantel_haenszel(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(*[F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(n) for n, q, t in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))])))
_Z = 1.959963984540054
query("proportion_ci", f"WITH s AS (SELECT source, sum(quality) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, n::DOUBLE AS m, {_Z}::DOUBLE AS z FROM s), w AS (SELECT *, (p + z * z / (2 * m)) / (1 + z * z / m) AS mid, z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m) AS half, z * sqrt(p * (1 - p) / m) AS wald, (k + z * z / 2) / (m + z * z) AS q FROM p) SELECT source, CAST(k AS BIGINT) AS k, n, round(p, 6) AS p, round(mid - half, 6) AS wilson_low, round(mid + half, 6) AS wilson_high, round(p - wald, 6) AS wald_low, round(p + wald, 6) AS wald_high, round(q - z * sqrt(q * (1 - q) / (m + z * z)), 6) AS agresti_low, round(q + z * sqrt(q * (1 - q) / (m + z * z)), 6) AS agresti_high FROM w")(lambda spark, d: T.proportion_ci(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n")), "k", "n"))
_META = "m AS (SELECT p_brand AS brand, avg(l_discount) - 0.05 AS y, var_samp(l_discount) / count(*) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) > 2)"


def _meta(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"))
    return t.groupBy("brand").agg((F.avg("l_discount") - 0.05).alias("y"), (F.var_samp("l_discount") / F.count(F.lit(1))).alias("v"), F.count(F.lit(1)).alias("c")).where("c > 2").drop("c")


query("meta_analysis", f"WITH {_META}, f AS (SELECT sum(1 / v) AS w, sum(y / v) AS wy, sum(y * y / v) AS wy2, sum(1 / v ** 2) AS w2, count(*) AS k FROM m), q AS (SELECT *, wy2 - wy * wy / w AS q FROM f), t AS (SELECT *, greatest(0, (q - (k - 1)) / (w - w2 / w)) AS tau2 FROM q) SELECT round(any_value(wy / w), 6) AS fixed, round(any_value(q), 6) AS q, round(any_value(greatest(0, (q - (k - 1)) / q)), 6) AS i2, round(any_value(tau2), 6) AS tau2, any_value(k) AS k, round(sum(y / (v + tau2)) / sum(1 / (v + tau2)), 6) AS random, round(sqrt(1 / sum(1 / (v + tau2))), 6) AS random_se FROM m, t")(lambda spark, d: T.meta_analysis(_meta(spark, d), "y", "v"))
query("leave_one_out", f"WITH {_META}, t AS (SELECT sum(1 / v) AS w, sum(y / v) AS wy FROM m) SELECT brand, round((wy - y / v) / (w - 1 / v), 6) AS effect, round(sqrt(1 / (w - 1 / v)), 6) AS se FROM m, t")(lambda spark, d: T.leave_one_out(_meta(spark, d), "brand", "y", "v"))
query("cumulative_incidence", f"WITH {LIVES}, e AS (SELECT grp, time, CASE WHEN event = 1 THEN 1 WHEN time % 2 = 0 THEN 2 ELSE 0 END AS ev FROM lives), t AS (SELECT grp, time, count(*) FILTER (ev = 1) AS d, count(*) FILTER (ev > 0) AS al, count(*) AS m FROM e GROUP BY 1, 2), r AS (SELECT *, CAST(sum(m) OVER (PARTITION BY grp ORDER BY time DESC) AS BIGINT) AS n FROM t), k AS (SELECT * FROM r WHERE al > 0), s AS (SELECT *, exp(coalesce(sum(CASE WHEN n > al THEN ln(1 - al / n) END) OVER (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM k) SELECT grp, time, d, n, round(sum(b * d / n) OVER (PARTITION BY grp ORDER BY time), 6) AS incidence FROM s")(lambda spark, d: T.cumulative_incidence(lives(spark, d).withColumn("ev", F.when(F.col("event") == 1, 1).when(F.col("time") % 2 == 0, 2).otherwise(0)), "time", "ev", "grp"))
query("ewma_chart", "WITH RECURSIVE s AS (SELECT user_id AS key, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE value IS NOT NULL), g AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY key ORDER BY t)) AS mr FROM s), b AS (SELECT key, avg(v) AS center, avg(mr) / 1.128 AS sigma FROM g GROUP BY 1), e AS (SELECT s.key, t, v, 0.2 * v + 0.8 * center AS z FROM s JOIN b USING (key) WHERE t = 1 UNION ALL SELECT s.key, s.t, s.v, 0.2 * s.v + 0.8 * e.z FROM e JOIN s ON s.key = e.key AND s.t = e.t + 1), h AS (SELECT e.key, t, v, z, center, 3 * sigma * sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * t))) AS half FROM e JOIN b USING (key)) SELECT key, t, round(v, 6) AS v, round(z, 6) AS ewma, round(center - half, 6) AS low, round(center + half, 6) AS high, abs(z - center) > half AS signal FROM h")(lambda spark, d: T.ewma_chart(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"))

# clusters
_X = "c AS (SELECT vec_id AS key, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
query("calinski_harabasz", f"WITH {_X}, g AS (SELECT label, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM c GROUP BY 1, 2), t AS (SELECT i, sum(q - s * s / n) AS w, sum(s * s / n) - sum(s) ** 2 / sum(n) AS b, sum(n) AS n, count(*) AS k FROM g GROUP BY 1) SELECT round(sum(b) / (max(k) - 1) / (sum(w) / (max(n) - max(k))), 5) AS calinski_harabasz, max(k) AS k, CAST(max(n) AS BIGINT) AS n FROM t", 5)(lambda spark, d: K.variance_ratio(table(spark, d, "embeddings"), "vec_id", "embedding", "label"))
query("davies_bouldin", f"WITH {_X}, m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM (SELECT label, key, sqrt(sum((x - m) ** 2)) AS d FROM c JOIN m USING (label, i) GROUP BY 1, 2) GROUP BY 1), g AS (SELECT a.label AS p, b.label AS q, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT p, max((x.s + y.s) / gap) AS r FROM g JOIN s x ON x.label = p JOIN s y ON y.label = q GROUP BY 1) SELECT round(avg(r), 5) AS davies_bouldin FROM r", 5)(lambda spark, d: K.davies_bouldin(table(spark, d, "embeddings"), "vec_id", "embedding", "label"))
_D = "p AS (SELECT a.vec_id AS key, a.label, b.label AS other, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
query("silhouette", f"WITH {_D}, m AS (SELECT key, label, other, avg(d) AS d FROM p GROUP BY 1, 2, 3), t AS (SELECT key, label, max(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM m GROUP BY 1, 2) SELECT key, label, round(a, 5) AS a, round(b, 5) AS b, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM t", 5)(lambda spark, d: K.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label"))
query("dunn_index", f"WITH {_D} SELECT round(min(d) FILTER (label <> other) / max(d) FILTER (label = other), 5) AS dunn FROM p", 5)(lambda spark, d: K.dunn(table(spark, d, "embeddings"), "vec_id", "embedding", "label"))

# populations
_POP = DOSAGES + ", f AS (SELECT variant, sample % 2 AS g, count(*) * 2 AS n, sum(dosage)::DOUBLE / (count(*) * 2) AS p FROM dosages GROUP BY 1, 2)"


def _freq(spark, d):
    x = dosages(spark, d)
    return O.frequencies(x, x.select("sample").distinct().withColumn("g", F.col("sample") % 2), "variant", "sample", "dosage", "g")


query("fst", f"WITH {_POP}, t AS (SELECT a.variant, a.p, b.p AS q, a.n, b.n AS m FROM f a JOIN f b ON a.variant = b.variant AND a.g = 0 AND b.g = 1), u AS (SELECT variant, (p - q) ** 2 - p * (1 - p) / (n - 1) - q * (1 - q) / (m - 1) AS x, p * (1 - q) + q * (1 - p) AS y FROM t) SELECT variant, round(x, 6) AS numerator, round(y, 6) AS dxy, CASE WHEN y > 0 THEN round(x / y, 6) END AS fst FROM u")(lambda spark, d: O.fst(_freq(spark, d), "variant", "g", 0, 1))
query("tajimas_d", f"WITH {DOSAGES}, s AS (SELECT variant, (count(*) * 2)::DOUBLE AS n, sum(dosage)::DOUBLE AS k FROM dosages GROUP BY 1), t AS (SELECT sum(2 * k * (n - k) / (n * (n - 1))) AS pi, count(*) FILTER (k > 0 AND k < n)::DOUBLE AS s, max(n) AS n FROM s), a AS (SELECT *, (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT CAST(max(n) AS BIGINT) FROM t)) r(i)) AS a1, (SELECT sum(1.0::DOUBLE / (i * i)) FROM range(1, (SELECT CAST(max(n) AS BIGINT) FROM t)) r(i)) AS a2 FROM t), e AS (SELECT *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 AS e1, (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM a) SELECT round(pi, 5) AS pi, CAST(s AS BIGINT) AS segregating, round(s / a1, 5) AS theta, round((pi - s / a1) / sqrt(e1 * s + e2 * s * (s - 1)), 5) AS tajimas_d, CAST(n AS BIGINT) AS n FROM e", 5)(lambda spark, d: O.diversity(dosages(spark, d), "variant", "dosage"))
query("site_frequency_spectrum", f"WITH {DOSAGES}, s AS (SELECT count(*) * 2 AS n, sum(dosage) AS k FROM dosages GROUP BY variant) SELECT CAST(least(k, n - k) AS BIGINT) AS copies, count(*) AS sites FROM s GROUP BY 1")(lambda spark, d: O.site_frequency_spectrum(dosages(spark, d), "variant", "dosage"))
query("genotype_grm", f"WITH {DOSAGES}, f AS (SELECT variant, avg(dosage) / 2 AS p FROM dosages GROUP BY 1), z AS (SELECT variant, sample, (dosage - 2 * p) / sqrt(2 * p * (1 - p)) AS z FROM dosages JOIN f USING (variant) WHERE p > 0 AND p < 1) SELECT a.sample AS a, b.sample AS b, round(avg(a.z * b.z), 5) AS relationship, count(*) AS n FROM z a JOIN z b ON a.variant = b.variant AND a.sample <= b.sample GROUP BY 1, 2", 5)(lambda spark, d: O.relationship(dosages(spark, d), "variant", "sample", "dosage"))
query("ld_decay", f"WITH {DOSAGES}, p AS (SELECT x.variant AS a, y.variant AS b, CASE WHEN var_pop(x.dosage) > 0 AND var_pop(y.dosage) > 0 THEN corr(x.dosage, y.dosage) ** 2 END AS r2 FROM dosages x JOIN dosages y ON x.sample = y.sample AND y.variant - x.variant BETWEEN 1 AND 8 GROUP BY 1, 2) SELECT CAST(floor((b - a) / 3) AS BIGINT) AS bin, count(r2) AS n, round(avg(r2), 6) AS mean_r2 FROM p GROUP BY 1")(lambda spark, d: O.ld_decay(N.ld(dosages(spark, d), "variant", "sample", "dosage", 8), 3))

# proteins
_CODE = ", ".join(f"'{c}': '{a}'" for c, a in R.genetic_code().items())
query("translate", f"WITH {DNA}, k AS (SELECT doc_id, i, coalesce((MAP {{{_CODE}}})[seq[i:i+2]], 'X') AS a FROM dna, range(1, greatest(len(seq) - 1, 1), 3) t(i)), p AS (SELECT doc_id, string_agg(a, '' ORDER BY i) AS p FROM k GROUP BY 1) SELECT doc_id, md5(coalesce(p, '')) AS md5 FROM dna LEFT JOIN p USING (doc_id)")(lambda spark, d: R.translate(dna(spark, d), "seq").select("doc_id", F.md5("protein").alias("md5")))
query("codon_usage", f"WITH {DNA}, k AS (SELECT doc_id AS key, seq[i:i+2] AS codon, count(*) AS n FROM dna, range(1, greatest(len(seq) - 1, 1), 3) t(i) WHERE NOT contains(seq[i:i+2], 'N') GROUP BY 1, 2), a AS (SELECT *, (MAP {{{_CODE}}})[codon] AS amino FROM k), f AS (SELECT a AS amino, count(*) AS c FROM (SELECT unnest(map_values(MAP {{{_CODE}}})) AS a) GROUP BY 1) SELECT key, codon, n, amino, round(n / sum(n) OVER (PARTITION BY key), 6) AS share, round(n * c / sum(n) OVER (PARTITION BY key, amino), 6) AS rscu FROM a JOIN f USING (amino)")(lambda spark, d: R.codon_usage(dna(spark, d), "doc_id", "seq"))
query("restriction_sites", f"WITH {DNA}, k AS (SELECT doc_id AS key, seq[i:i+3] AS k FROM dna, range(1, len(seq) + 1) t(i)) SELECT key, 'AluI' AS motif, CAST(count(*) FILTER (k = 'AGCT') AS INT) AS n FROM k GROUP BY 1 UNION ALL SELECT key, 'TaqI', CAST(count(*) FILTER (k = 'TCGA') AS INT) FROM k GROUP BY 1")(lambda spark, d: R.restriction_sites(dna(spark, d), "doc_id", "seq", ["AluI", "TaqI"]))
_COUNT = lambda p: f"len(regexp_replace(s, '[^{p}]', '', 'g'))"
_SUM = lambda t: " + ".join(f"{_COUNT(a)} * ({v}::DOUBLE)" for a, v in t.items())
query("protein_properties", f"WITH x AS (SELECT doc_id AS key, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents), n AS (SELECT *, {_COUNT('ACDEFGHIKLMNPQRSTVWY')} AS n FROM x) SELECT key, CAST(n AS INT) AS length, round({_SUM(R.MASSES)} + 18.0153, 4) AS mass, round(({_SUM(R.HYDROPATHY)}) / n, 4) AS gravy, round({_COUNT('FWY')} / n, 4) AS aromaticity, {_COUNT('W')} * 5500 + {_COUNT('Y')} * 1490 + {_COUNT('C')} // 2 * 125 AS extinction, CAST({_COUNT('KR')} - {_COUNT('DE')} AS INT) AS charge FROM n", 4)(lambda spark, d: R.protein_properties(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"))
query("gc_skew_profile", f"WITH {DNA}, w AS (SELECT doc_id AS key, i - 1 AS start, seq[i:i+99] AS s FROM dna, range(1, greatest(len(seq) - 98, 1), 50) t(i) WHERE len(seq) >= 100), c AS (SELECT key, CAST(start AS INT) AS start, {_COUNT('G')} AS g, {_COUNT('C')} AS c, {_COUNT('AT')} AS a FROM w), k AS (SELECT key, start, (g + c) / nullif(g + c + a, 0) AS gc, CASE WHEN g + c > 0 THEN (g - c) / (g + c) ELSE 0 END AS skew FROM c) SELECT key, start, round(gc, 6) AS gc, round(skew, 6) AS skew, round(sum(skew) OVER (PARTITION BY key ORDER BY start), 6) AS cumulative FROM k")(lambda spark, d: R.gc_skew_profile(dna(spark, d), "doc_id", "seq", 100, 50))

"""Queries over features along sequences, contacts, call sets, count tables and the numbers behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import tracks as K
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, INTERVALS, cells, intervals, table
from tessella.plans.tails import choose

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql, places=6):
    def add(f):
        QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
        SQL[name] = sql
        return f

    return add


def _merged(gap: int) -> str:
    return f"{INTERVALS}, m0 AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM a), m1 AS (SELECT *, sum(CASE WHEN u IS NULL OR s - u > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m0), m AS (SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM m1 GROUP BY chrom, i)"


_genes = lambda spark, d: intervals(spark, d)[0]
query("peak_merge", f'WITH {_merged(5)} SELECT chrom, s AS start, e AS "end", n, e - s AS width FROM m')(lambda spark, d: K.peak_merge(_genes(spark, d), 5))
query("genome_intergenic_regions", f'WITH {_merged(0)} SELECT chrom, u AS start, s AS "end", s - u AS length FROM m0 WHERE u IS NOT NULL AND s - u >= 2')(lambda spark, d: K.intergenic(_genes(spark, d), 2))
query("genome_gene_density", f'WITH {_merged(0)}, li AS (SELECT chrom, max(e) AS top FROM a GROUP BY 1), w AS (SELECT chrom, top, unnest(range((top - 1) // 90 + 1)) AS w FROM li), wb AS (SELECT chrom, w * 90 AS ws, least((w + 1) * 90, top) AS we FROM w), wn AS (SELECT wb.chrom, ws, we, count(a.s) AS n FROM wb LEFT JOIN a ON a.chrom = wb.chrom AND a.s < we AND a.e > ws GROUP BY ALL), wc AS (SELECT wb.chrom, ws, coalesce(sum(least(m.e, we) - greatest(m.s, ws)) FILTER (m.s IS NOT NULL), 0) AS covered FROM wb LEFT JOIN m ON m.chrom = wb.chrom AND m.s < we AND m.e > ws GROUP BY ALL) SELECT chrom, ws AS start, we AS "end", n AS n_features, round(n * 1000 / (we - ws)::DOUBLE, 6) AS per_kb, CAST(covered AS BIGINT) AS covered, round(covered / (we - ws)::DOUBLE, 6) AS fraction FROM wn JOIN wc USING (chrom, ws)')(lambda spark, d: K.gene_density(_genes(spark, d), 90))


# call sets: parts as sites
def _calls(spark, d, keep, shift):
    p = table(spark, d, "part").where(F.col("p_partkey") % keep != 0)
    return p.select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), ((F.col("p_size") + shift * (F.col("p_partkey") % 7 == 1).cast("int")) % 3 + 1).cast("int")).alias("gt"))


def _calls_sql(name: str, keep: int, shift: int) -> str:
    return f"{name} AS (SELECT p_brand AS chrom, p_partkey AS pos, 'A' AS ref, 'C' AS alt, ['0/0', '0/1', '1/1'][(p_size + {shift} * CAST(p_partkey % 7 = 1 AS INT)) % 3 + 1] AS gt FROM part WHERE p_partkey % {keep} <> 0)"


_SITES = f"{_calls_sql('qs', 5, 0)}, {_calls_sql('ts', 3, 1)}, f AS (SELECT coalesce(qs.chrom, ts.chrom) AS chrom, coalesce(qs.pos, ts.pos) AS pos, coalesce(qs.ref, ts.ref) AS ref, coalesce(qs.alt, ts.alt) AS alt, qs.gt AS q, ts.gt AS t FROM qs FULL JOIN ts ON qs.chrom = ts.chrom AND qs.pos = ts.pos AND qs.ref = ts.ref AND qs.alt = ts.alt)"
query("vcf_merge", f"WITH {_SITES} SELECT chrom, pos, ref, alt, coalesce(q, './.') AS gt_a, coalesce(t, './.') AS gt_b FROM f")(lambda spark, d: K.vcf_merge(_calls(spark, d, 5, 0), _calls(spark, d, 3, 1)))
query("vcf_concordance", f"WITH {_SITES}, c AS (SELECT count(*) FILTER (q IS NOT NULL AND t IS NOT NULL) AS shared, count(*) FILTER (t IS NULL) AS only_query, count(*) FILTER (q IS NULL) AS only_truth, count(*) FILTER (q = t) AS equal FROM f) SELECT shared, only_query, only_truth, round(shared / (shared + only_query), 6) AS precision, round(shared / (shared + only_truth), 6) AS recall, round(2 * shared / (2 * shared + only_query + only_truth), 6) AS f1, round(equal / shared, 6) AS genotype_concordance FROM c")(lambda spark, d: K.vcf_concordance(_calls(spark, d, 5, 0), _calls(spark, d, 3, 1)))

# contacts: a line's part and order as two places
_PAIRS = "pr AS (SELECT 'c' || l_linenumber % 3 AS chrom1, l_partkey * 100 AS pos1, 'c' || l_orderkey % 3 AS chrom2, l_orderkey * 10 AS pos2 FROM lineitem)"


def _contacts(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("chrom1"), (F.col("l_partkey") * 100).alias("pos1"), F.concat(F.lit("c"), F.col("l_orderkey") % 3).alias("chrom2"), (F.col("l_orderkey") * 10).alias("pos2"))


def _binned(spark, d):
    """Contacts within a sequence by bins of 10,000, with their counts."""
    at = lambda c: (F.floor(F.col(c) / 10000) * 10000).alias(f"start{c[-1]}")
    return _contacts(spark, d).where("chrom1 = chrom2").groupBy("chrom1", at("pos1"), at("pos2")).agg(F.count(F.lit(1)).alias("count"))


query("hic_pair_stats", f"WITH {_PAIRS}, c AS (SELECT count(*) FILTER (chrom1 = chrom2) AS cis, count(*) FILTER (chrom1 <> chrom2) AS trans FROM pr) SELECT cis, trans, cis + trans AS total, round(cis / (cis + trans), 6) AS cis_fraction FROM c")(lambda spark, d: K.pair_stats(_contacts(spark, d)))
query("hic_contact_matrix", f"WITH {_PAIRS}, b AS (SELECT chrom1, chrom2, pos1 // 10000 AS x, pos2 // 10000 AS y FROM pr) SELECT CASE WHEN (chrom1, x) <= (chrom2, y) THEN chrom1 ELSE chrom2 END AS chrom1, CASE WHEN (chrom1, x) <= (chrom2, y) THEN x ELSE y END AS bin1, CASE WHEN (chrom1, x) <= (chrom2, y) THEN chrom2 ELSE chrom1 END AS chrom2, CASE WHEN (chrom1, x) <= (chrom2, y) THEN y ELSE x END AS bin2, count(*) AS n FROM b GROUP BY ALL")(lambda spark, d: K.contact_matrix(_contacts(spark, d), 10000, True))
_DECAY = f"{_PAIRS}, c AS (SELECT chrom1, pos1 // 10000 * 10000 AS x, pos2 // 10000 * 10000 AS y, count(*) AS c FROM pr WHERE chrom1 = chrom2 GROUP BY ALL), d AS (SELECT abs(x - y)::DOUBLE AS d, c FROM c WHERE x <> y), m AS (SELECT greatest(1.0, min(d)) AS lo, greatest(max(d), min(d) + 1) AS hi, sum(c) AS grand FROM d), e AS (SELECT i, CASE i WHEN 0 THEN lo WHEN 20 THEN hi ELSE 10.0::DOUBLE ** (log10(lo) + (log10(hi) - log10(lo)) * i / 20) END AS e FROM m, (SELECT unnest(range(21)) AS i)), b AS (SELECT i AS bin, e AS low, lead(e) OVER (ORDER BY i) AS high FROM e)"
query("hic_distance_decay", f"WITH {_DECAY}, n AS (SELECT bin, count(*) AS contacts, sum(c) AS pairs FROM d JOIN b ON d >= low AND (d < high OR (bin = 19 AND d = high)) WHERE high IS NOT NULL GROUP BY 1) SELECT CAST(bin AS INT) AS bin, round(low, 4) AS low, round(high, 4) AS high, coalesce(contacts, 0) AS contacts, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, round(coalesce(pairs / contacts, 0), 4) AS mean_count, round(coalesce(pairs, 0) / grand, 4) AS share FROM b LEFT JOIN n USING (bin), m WHERE high IS NOT NULL", 4)(lambda spark, d: K.distance_decay(_binned(spark, d), "start1", "start2", "count"))

# counts
query("counts_normalize", "WITH t AS (SELECT p_partkey AS key, p_size::DOUBLE AS c, p_retailprice / 1000 AS kb FROM part), s AS (SELECT sum(c) AS total, sum(c / kb) AS rates FROM t) SELECT key, round(c / total * 1e6, 4) AS cpm, round(c / kb / total * 1e6, 4) AS fpkm, round(c / kb / rates * 1e6, 4) AS tpm FROM t, s", 4)(lambda spark, d: K.counts_normalize(table(spark, d, "part"), "p_partkey", "p_size", "p_retailprice"))
query("hvg", f"WITH {CELLS}, s AS (SELECT part AS key, avg(value) AS mean, var_samp(value) AS variance FROM cells GROUP BY 1 HAVING avg(value) BETWEEN 20 AND 1e9), d AS (SELECT *, coalesce(variance / mean, 0) AS dispersion FROM s) SELECT key, round(mean, 6) AS mean, round(variance, 6) AS variance, round(dispersion, 6) AS dispersion FROM d ORDER BY d.dispersion DESC, key LIMIT 50")(lambda spark, d: K.highly_variable(cells(spark, d), "part", "value", 50, 20, 1e9))
query("box_cox", f"WITH {CELLS} SELECT part, flag, round((value ** 0.5 - 1) / 0.5, 6) AS value FROM cells")(lambda spark, d: K.box_cox(cells(spark, d), lam=0.5))
query("rarefaction", f"WITH {CELLS}, t AS (SELECT part AS key, value AS x, sum(value) OVER (PARTITION BY part) AS n FROM cells WHERE value > 0), r AS (SELECT key, CASE WHEN n >= 20 THEN 1 - CASE WHEN n - x >= 20 THEN exp({choose('n - x', '20')} - {choose('n', '20')}) ELSE 0 END END AS p FROM t) SELECT key, round(sum(p), 6) AS expected, count(*) AS observed FROM r GROUP BY 1")(lambda spark, d: K.rarefaction(cells(spark, d), "part", "value", 20))
_BAL = "t AS (SELECT CAST(c_custkey % 3 = 0 AS INT) AS t, c_custkey % 5 <> 0 AS m, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer), l AS (SELECT t, m, 'c_acctbal' AS covariate, a AS v FROM t UNION ALL SELECT t, m, 'c_nationkey', b FROM t)"
_PSM = ", ".join(f"avg(v) FILTER (t = {t}{w}) AS m{t}{n}, var_samp(v) FILTER (t = {t}{w}) AS v{t}{n}" for n, w in (("b", ""), ("a", " AND m")) for t in (0, 1))
query("psm_balance", f"WITH {_BAL}, s AS (SELECT covariate, {_PSM} FROM l GROUP BY 1) SELECT covariate, round((m1b - m0b) / sqrt((v1b + v0b) / 2), 5) AS smd_before, round(v1b / v0b, 5) AS vr_before, round((m1a - m0a) / sqrt((v1a + v0a) / 2), 5) AS smd_after, round(v1a / v0a, 5) AS vr_after FROM s", 5)(lambda spark, d: K.balance(table(spark, d, "customer").withColumn("t", (F.col("c_custkey") % 3 == 0).cast("int")).withColumn("m", F.col("c_custkey") % 5 != 0), "t", "m", ["c_acctbal", "c_nationkey"]))

# plots
query("histogram", "WITH v AS (SELECT l_extendedprice::DOUBLE AS v FROM lineitem), e AS (SELECT min(v) AS a, max(v) - min(v) AS s FROM v), n AS (SELECT least(CAST(floor((v - a) / s * 40) AS INT), 39) AS bin, count(*) AS n FROM v, e GROUP BY 1), b AS (SELECT CAST(unnest(range(40)) AS INT) AS bin) SELECT bin, round(a + s * bin / 40, 4) AS low, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (bin), e", 4)(lambda spark, d: K.histogram(table(spark, d, "lineitem"), "l_extendedprice"))
query("boxplot", "WITH v AS (SELECT o_orderpriority AS key, o_totalprice AS v FROM orders), q AS (SELECT key, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1), i AS (SELECT *, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM v JOIN q USING (key)) SELECT key, round(min(v) FILTER (ok), 4) AS low, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, round(max(v) FILTER (ok), 4) AS high, count(*) FILTER (NOT ok) AS outliers FROM i GROUP BY key, q1, q2, q3", 4)(lambda spark, d: K.boxplot(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))

"""Queries over assemblies, alignments, genotype calls, expression sums, motifs and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregate as A
from tessella.operators import alignments as L
from tessella.operators import assembly as S
from tessella.operators import ecology as E
from tessella.operators import enrichment as N
from tessella.operators import populations as O
from tessella.operators import proteins as R
from tessella.operators import series as T
from tessella.operators import variants as V
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, DNA, cells, dna, table
from tessella.plans.tails import choose

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql, places=6):
    def add(f):
        QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
        SQL[name] = sql
        return f

    return add


# assemblies: the documents' letters as contigs
_LEN = DNA + ", c AS (SELECT doc_id, seq, len(seq) AS len FROM dna), p AS (SELECT len FROM c WHERE len > 0), r AS (SELECT len, row_number() OVER w AS k, sum(len) OVER w AS upto FROM p WINDOW w AS (ORDER BY len DESC ROWS UNBOUNDED PRECEDING)), w AS (SELECT count(*) AS contigs, CAST(sum(len) AS BIGINT) AS bases, max(len) AS longest, sum(len * len)::DOUBLE / sum(len) AS aun FROM p)"
_contigs = lambda spark, d: dna(spark, d).withColumn("len", F.length("seq").cast("long"))
query("assembly_ngx_metrics", f"WITH {_LEN}, g AS (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS share), f AS (SELECT share, min(k) AS lx FROM g, w, r WHERE upto >= share * bases GROUP BY 1) SELECT share, len AS nx, lx, contigs, bases, longest, round(aun, 6) AS aun FROM f JOIN r ON k = lx, w")(lambda spark, d: S.length_metrics(_contigs(spark, d), "len", (0.1, 0.5, 0.9)).withColumn("longest", F.col("longest")))
query("assembly_gap_stats", f"WITH {DNA}, g AS (SELECT doc_id, seq, regexp_extract_all(seq, 'N+') AS r FROM dna) SELECT doc_id AS key, CAST(len(seq) AS INT) AS length, CAST(len(r) AS INT) AS gaps, CAST(coalesce(list_sum(list_transform(r, lambda x: len(x))), 0) AS INT) AS gap_bases, CAST(coalesce(list_max(list_transform(r, lambda x: len(x))), 0) AS INT) AS longest_gap FROM g")(lambda spark, d: S.gap_stats(dna(spark, d), "doc_id", "seq"))
query("assembly_length_bins", f"WITH {_LEN}, b AS (SELECT len, CASE WHEN len >= 5000 THEN 5000 WHEN len >= 1000 THEN 1000 WHEN len >= 100 THEN 100 ELSE 0 END AS low FROM c) SELECT CAST(low AS BIGINT) AS low, count(*) AS contigs, CAST(sum(len) AS BIGINT) AS bases FROM b GROUP BY 1")(lambda spark, d: S.length_bins(_contigs(spark, d), "len", [0, 100, 1000, 5000]))
query("sequence_kmer_profile", f"WITH {DNA}, k AS (SELECT doc_id AS key, seq[i:i+2] AS kmer, count(*)::DOUBLE AS n FROM dna, range(1, greatest(len(seq) - 1, 1)) t(i) WHERE len(seq[i:i+2]) = 3 AND NOT contains(seq[i:i+2], 'N') GROUP BY 1, 2), t AS (SELECT key, sum(n) AS total, count(*) AS c, sum(n * log2(n)) AS h, max(n) AS m FROM k GROUP BY 1), d AS (SELECT key, min(kmer) AS dominant FROM k JOIN t USING (key) WHERE n = m GROUP BY 1) SELECT key, CAST(total AS BIGINT) AS total, round(c / total, 6) AS distinct_share, round(log2(total) - h / total, 6) AS entropy, dominant, round(m / total, 6) AS dominant_share FROM t JOIN d USING (key)")(lambda spark, d: S.kmer_profile(dna(spark, d), "doc_id", "seq", 3))
_PWM = [{"A": 8, "C": 1, "G": 1, "T": 0}, {"A": 0, "C": 9, "G": 0, "T": 1}, {"A": 1, "C": 0, "G": 8, "T": 1}, {"A": 0, "C": 0, "G": 1, "T": 9}]
_W = " + ".join("CASE substr(w, {}, 1) {} END".format(i + 1, " ".join(f"WHEN '{b}' THEN log2(({c[b]} + 0.5::DOUBLE) / 12 / 0.25)" for b in "ACGT")) for i, c in enumerate(_PWM))
query("pwm_scan", f"WITH {DNA}, k AS (SELECT doc_id AS key, CAST(i - 1 AS INT) AS start, seq[i:i+3] AS w FROM dna, range(1, greatest(len(seq) - 2, 1)) t(i) WHERE len(seq[i:i+3]) = 4 AND NOT contains(seq[i:i+3], 'N')), s AS (SELECT *, {_W} AS score FROM k) SELECT key, start, w, round(score, 6) AS score FROM s WHERE score >= 5")(lambda spark, d: R.pwm_scan(dna(spark, d), "doc_id", "seq", _PWM, 5.0))
_MSA = "al AS (SELECT rpad(upper(url), CAST((SELECT max(len(url)) FROM pages) AS INT), '-') AS s FROM pages WHERE url IS NOT NULL)"
query("msa_consensus", f"WITH {_MSA}, c AS (SELECT CAST(i - 1 AS INT) AS pos, s[i] AS letter FROM al, range(1, (SELECT max(len(url)) FROM pages) + 1) t(i)), n AS (SELECT pos, letter, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT pos, sum(n) AS total, coalesce(sum(n) FILTER (letter = '-'), 0) AS gaps FROM n GROUP BY 1), b AS (SELECT pos, letter AS consensus, n AS m FROM n WHERE letter <> '-' QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, letter) = 1), h AS (SELECT pos, sum(-(n / (total - gaps)) * log2(n / (total - gaps))) AS e FROM n JOIN t USING (pos) WHERE letter <> '-' GROUP BY 1) SELECT t.pos, CAST(total AS BIGINT) AS total, CAST(gaps AS BIGINT) AS gaps, consensus, round(m / (total - gaps), 6) AS share, round(e, 6) AS entropy FROM t LEFT JOIN b USING (pos) LEFT JOIN h USING (pos)")(lambda spark, d: R.alignment_columns(_aligned(spark, d), "page_id", "s"))


def _aligned(spark, d):
    """Every page's whole url as a row of an alignment, padded to the longest one with gaps."""
    pages = table(spark, d, "pages").where("url is not null")
    longest = pages.agg(F.max(F.length("url"))).first()[0] or 0
    return pages.select("page_id", F.rpad(F.upper("url"), longest, "-").alias("s"))


# alignments: order lines with a made flag
_READS = "rd AS (SELECT CAST((l_orderkey * 7 + l_linenumber * 257) % 4096 AS INT) AS flag, CAST((l_partkey + l_linenumber) % 70 AS INT) AS mapq, CAST(l_quantity AS BIGINT) + 50 AS len FROM lineitem)"


def _reads(spark, d):
    return table(spark, d, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 257) % 4096).cast("int").alias("flag"), ((F.col("l_partkey") + F.col("l_linenumber")) % 70).cast("int").alias("mapq"), (F.col("l_quantity").cast("long") + 50).alias("len"))


_bit = lambda n: f"(flag & {L.BITS[n]}) <> 0"
_no = lambda n: f"(flag & {L.BITS[n]}) = 0"
_P = f"{_no('secondary')} AND {_no('supplementary')}"
_PP = f"{_P} AND {_bit('paired')}"
query("bam_flagstat", f"WITH {_READS} SELECT count(*) AS total, count(*) FILTER ({_P}) AS \"primary\", count(*) FILTER ({_bit('secondary')}) AS secondary, count(*) FILTER ({_bit('supplementary')} AND {_no('secondary')}) AS supplementary, count(*) FILTER ({_bit('duplicate')}) AS duplicates, count(*) FILTER ({_bit('failed')}) AS failed, count(*) FILTER ({_no('unmapped')}) AS mapped, count(*) FILTER ({_P} AND {_no('unmapped')}) AS primary_mapped, count(*) FILTER ({_PP}) AS paired, count(*) FILTER ({_PP} AND {_bit('first')}) AS read1, count(*) FILTER ({_PP} AND {_bit('second')}) AS read2, count(*) FILTER ({_PP} AND {_bit('proper')} AND {_no('unmapped')}) AS proper, count(*) FILTER ({_PP} AND {_no('unmapped')} AND {_no('mate_unmapped')}) AS both_mapped, count(*) FILTER ({_PP} AND {_no('unmapped')} AND {_bit('mate_unmapped')}) AS singletons FROM rd")(lambda spark, d: L.flagstat(_reads(spark, d)))
query("bam_mapq_distribution", f"WITH {_READS}, m AS (SELECT least(mapq, 60) AS mapq, count(*) AS n FROM rd WHERE {_P} AND {_no('unmapped')} GROUP BY 1) SELECT mapq, n, round(sum(n) OVER (ORDER BY mapq DESC) / sum(n) OVER (), 6) AS at_least FROM m")(lambda spark, d: L.mapq_distribution(_reads(spark, d)))
query("bam_read_length_stats", f"WITH {_READS}, r AS (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER () AS bases FROM rd) SELECT count(*) AS reads, CAST(any_value(bases) AS BIGINT) AS bases, max(len) AS longest, max(len) FILTER (upto >= bases * 0.5) AS n50, min(len) AS least, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.5), 6) AS median FROM r")(lambda spark, d: L.read_lengths(_reads(spark, d), "len"))

# genotype calls of parts (variants) and customers (samples), one in four missing
_CALLS = "ca AS (SELECT l_partkey AS variant, o_custkey AS sample, nullif(sum(l_linenumber) % 4, 3) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _calls(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy(F.col("l_partkey").alias("variant"), F.col("o_custkey").alias("sample")).agg(F.nullif(F.sum("l_linenumber") % 4, F.lit(3)).cast("long").alias("dosage"))


query("vcf_site_missingness", f"WITH {_CALLS} SELECT variant, count(dosage) AS called, count(*) - count(dosage) AS missing, round(count(dosage) / count(*), 6) AS call_rate FROM ca GROUP BY 1")(lambda spark, d: V.site_missingness(_calls(spark, d), "variant", "dosage"))
query("vcf_sample_stats", f"WITH {_CALLS}, s AS (SELECT sample, count(*) AS sites, count(dosage) AS called, count(*) FILTER (dosage = 0) AS hom_ref, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom_alt FROM ca GROUP BY 1) SELECT sample, sites, called, round(called / sites, 6) AS call_rate, hom_ref, het, hom_alt, CASE WHEN hom_alt > 0 THEN round(het / hom_alt, 6) END AS het_hom_ratio FROM s")(lambda spark, d: V.sample_stats(_calls(spark, d), "sample", "dosage"))
query("genotype_filter", f"WITH {_CALLS}, k AS (SELECT variant, count(dosage) / count(*) AS r, sum(dosage) / (2.0::DOUBLE * count(dosage)) AS p FROM ca GROUP BY 1) SELECT variant, sample, CAST(dosage AS BIGINT) AS dosage FROM ca WHERE variant IN (SELECT variant FROM k WHERE r >= 0.75 AND least(p, 1 - p) >= 0.2)")(lambda spark, d: V.genotype_filter(_calls(spark, d), "variant", "dosage", 0.75, 0.2))
_like = lambda i: f"exp(({i}) * ln(2.0::DOUBLE) - lgamma(({i}) + 1.0::DOUBLE) - lgamma((mi - ({i})) / 2 + 1.0::DOUBLE) - lgamma(n - ({i}) - (mi - ({i})) / 2 + 1.0::DOUBLE) - top)"
_HWE = _CALLS + f", c AS (SELECT variant, count(*) FILTER (dosage = 0) AS a, count(*) FILTER (dosage = 1) AS h, count(*) FILTER (dosage = 2) AS b FROM ca GROUP BY 1), m AS (SELECT *, a + h + b AS n, 2 * least(a, b) + h AS mi FROM c), t AS (SELECT *, h * ln(2.0::DOUBLE) - lgamma(h + 1.0::DOUBLE) - lgamma((mi - h) / 2 + 1.0::DOUBLE) - lgamma(n - h - (mi - h) / 2 + 1.0::DOUBLE) AS top FROM m), l AS (SELECT *, list_transform(range(mi % 2, mi + 1, 2), lambda i: {_like('i')}) AS p FROM t), p AS (SELECT *, CASE WHEN n > 0 THEN least(1, list_sum(list_filter(p, lambda x: x <= 1 + 1e-7::DOUBLE)) / list_sum(p)) END AS p2 FROM l)"
query("hwe_test", f"WITH {_HWE} SELECT variant, a AS hom_ref, h AS het, b AS hom_alt, round(p2, 6) AS p FROM p")(lambda spark, d: V.hwe_test(_calls(spark, d), "variant", "dosage"))
query("hwe", f"WITH {_HWE} SELECT variant, sample, CAST(dosage AS BIGINT) AS dosage FROM ca WHERE variant IN (SELECT variant FROM p WHERE p2 >= 0.05)")(lambda spark, d: V.hwe_filter(_calls(spark, d), "variant", "dosage", 0.05))
_WIN = _CALLS + ", s AS (SELECT variant, 2.0::DOUBLE * count(dosage) AS n, sum(dosage) AS k FROM ca GROUP BY 1 HAVING count(dosage) > 0), w AS (SELECT variant // 50 AS w, sum(2 * k * (n - k) / (n * (n - 1))) / 50 AS pi, count(*) FILTER (k > 0 AND k < n) AS seg, max(n) AS c FROM s GROUP BY 1)"
query("nucleotide_diversity", f"WITH {_WIN} SELECT w AS \"window\", round(pi, 6) AS pi FROM w")(lambda spark, d: V.windowed_diversity(_calls(spark, d), "variant", "dosage", 50).select("window", "pi"))
query("watterson_theta", f"WITH {_WIN} SELECT w AS \"window\", seg AS segregating, round(seg / list_sum(list_transform(range(1, CAST(c AS BIGINT)), lambda i: 1.0::DOUBLE / i)) / 50, 6) AS theta FROM w")(lambda spark, d: V.windowed_diversity(_calls(spark, d), "variant", "dosage", 50).select("window", "segregating", "theta"))
_DXY = _CALLS + ", f AS (SELECT variant, sample % 2 AS g, 2 * count(dosage) AS n, sum(dosage) / (2.0::DOUBLE * count(dosage)) AS p FROM ca WHERE dosage IS NOT NULL GROUP BY 1, 2), x AS (SELECT a.p AS p, b.p AS q, a.n AS n, b.n AS m FROM f a JOIN f b ON a.variant = b.variant AND a.g = 0 AND b.g = 1 WHERE a.n > 1 AND b.n > 1)"
query("dxy", f"WITH {_DXY} SELECT count(*) AS sites, round(avg(p * (1 - q) + q * (1 - p)), 6) AS dxy, round(sum((p - q) ** 2 - p * (1 - p) / (n - 1) - q * (1 - q) / (m - 1)) / sum(p * (1 - q) + q * (1 - p)), 6) AS fst FROM x")(lambda spark, d: _dxy(spark, d))


def _dxy(spark, d):
    c = _calls(spark, d)
    groups = c.select("sample").distinct().withColumn("g", F.col("sample") % 2)
    return V.population_distance(O.frequencies(c, groups, "variant", "sample", "dosage", "g"), "variant", "g", 0, 1)


# expression sums, series and species
query("pseudobulk", f"WITH {CELLS} SELECT p_brand AS brand, flag, round(sum(value), 6) AS value FROM cells JOIN part ON part = p_partkey GROUP BY 1, 2")(lambda spark, d: A.pseudobulk(cells(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")), "part", "flag", "brand"))
_CC = "s AS (SELECT l_suppkey AS key, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS t FROM lineitem), c AS (SELECT key, t, a - avg(a) OVER (PARTITION BY key) AS x, b - avg(b) OVER (PARTITION BY key) AS y FROM s), q AS (SELECT key, sqrt(sum(x * x) * sum(y * y)) AS ss FROM c GROUP BY 1), l AS (SELECT unnest(range(-2, 3)) AS lag), p AS (SELECT a.key, lag, sum(b.x * a.y) AS p FROM c a JOIN l ON true JOIN c b ON a.key = b.key AND b.t = a.t + lag GROUP BY 1, 2)"
query("cross_correlation", f"WITH {_CC} SELECT key, CAST(l.lag AS INT) AS lag, CASE WHEN ss > 0 THEN round(coalesce(p, 0) / ss, 6) END AS ccf FROM q JOIN l ON true LEFT JOIN p USING (key, lag)")(lambda spark, d: T.cross_correlation(table(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "l_quantity", "l_extendedprice", 2))
_ENT = CELLS + ", p AS (SELECT part AS key, value / sum(value) OVER (PARTITION BY part) AS p FROM cells WHERE value > 0), o AS (SELECT unnest([0, 0.5, 1, 2]::DOUBLE[]) AS q), s AS (SELECT key, q, sum(CASE WHEN q = 1 THEN -p * ln(p) ELSE p ** q END) AS s FROM p, o GROUP BY 1, 2), r AS (SELECT *, CASE WHEN q = 1 THEN s ELSE ln(s) / (1 - q) END AS r FROM s)"
query("renyi", f"WITH {_ENT} SELECT key, q AS \"order\", round(r, 6) AS renyi, round(exp(r), 6) AS hill FROM r")(lambda spark, d: E.entropies(cells(spark, d), "part").select("key", "order", "renyi", "hill"))
query("tsallis", f"WITH {_ENT} SELECT key, q AS \"order\", round(CASE WHEN q = 1 THEN s ELSE (1 - s) / (q - 1) END, 6) AS tsallis FROM r")(lambda spark, d: E.entropies(cells(spark, d), "part").select("key", "order", "tsallis"))
_POOL = "i AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem WHERE l_quantity > 0), n AS (SELECT count(DISTINCT l_suppkey)::DOUBLE AS n FROM lineitem), f AS (SELECT t, count(*)::DOUBLE AS f FROM i GROUP BY 1), a AS (SELECT any_value(n) AS n, count(*) AS seen, count(*) FILTER (f = 1) AS a1, count(*) FILTER (f = 2) AS a2, sum((1 - f / n) ** n) AS u FROM f, n)"
query("specpool", f"WITH {_POOL} SELECT seen, round(seen + CASE WHEN a2 > 0 THEN a1 * a1 / (2 * a2) ELSE a1 * (a1 - 1) / 2 END * (n - 1) / n, 6) AS chao, round(seen + a1 * (n - 1) / n, 6) AS jack1, round(seen + a1 * (2 * n - 3) / n - a2 * (n - 2) ** 2 / (n * (n - 1)), 6) AS jack2, round(seen + u, 6) AS boot FROM a")(lambda spark, d: E.species_pool(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity"))

# enrichment: parts over 100 in flag A against brands
_hg = lambda i: f"exp({choose('size', i)} + {choose('total - size', f'drawn - ({i})')} - {choose('total', 'drawn')})"
_ORA = CELLS + f", h AS (SELECT DISTINCT part FROM cells WHERE flag = 'A' AND value > 60), u AS (SELECT p_brand AS term, count(*) AS size, count(h.part) AS hits FROM part LEFT JOIN h ON h.part = p_partkey GROUP BY 1), w AS (SELECT *, (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM h) AS drawn FROM u), p AS (SELECT *, least(1, coalesce(list_sum(list_transform(range(greatest(hits, drawn - (total - size)), least(size, drawn) + 1), lambda i: {_hg('i')})), 0)) AS p FROM w), r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS k, count(*) OVER () AS m FROM p)"
query("ora", f"WITH {_ORA} SELECT term, hits, size, drawn, total, round((hits / drawn) / (size / total), 6) AS fold, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS q FROM r")(lambda spark, d: _ora(spark, d))


def _ora(spark, d):
    universe = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("term"))
    out = N.enrich(cells(spark, d).where("flag = 'A' and value > 60").select("part").distinct(), universe, "part", "term")
    return out.select("term", "hits", "size", "drawn", "total", "fold", "p", "q")

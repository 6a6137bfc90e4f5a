"""Queries over the core operators: shape, aggregation, scaling, intervals, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import aggregate as A
from tessella.operators import intervals as I
from tessella.operators import pairwise as P
from tessella.operators import scale as S
from tessella.operators import shape as H
from tessella.plans.fixtures import CELLS, HOLES, INTERVALS, cells, holes, intervals, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names, places=6):
    """Rounds as DuckDB does, the product with the power of ten to a whole number: a value half way by its decimals falls alike."""
    return df.select(*[(F.round(F.col(c) * 10.0**places) / 10.0**places).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"""WITH {CELLS}, kept AS (SELECT part FROM cells GROUP BY 1 HAVING count(*) FILTER (value >= 100) >= 2),
n AS (SELECT part, flag, value / sum(value) OVER (PARTITION BY flag) * 1e6 AS v FROM cells WHERE part IN (SELECT part FROM kept)),
g AS (SELECT p_brand AS brand, flag, avg(log2(v + 1)) AS v FROM n JOIN part ON part = p_partkey GROUP BY 1, 2)
SELECT brand, round(var_pop(v), 6) AS statistic FROM g GROUP BY 1 ORDER BY var_pop(v) DESC, brand LIMIT 10""")
def flagship(spark, d):
    """The flagship: filter, normalize, log, aggregate by group, top labels."""
    x = H.filter_min(cells(spark, d), "part", min_value=100, min_samples=2)
    x = S.log_transform(S.normalize(x, "flag", "part", method="cpm"))
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return rounded(H.rank_axis(A.aggregate(x, groups, "part", "brand", "flag", method="mean"), "brand", "variance", top_n=10).drop("rank"), "statistic")


@query("SELECT c_custkey, c_mktsegment, c_acctbal, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 ELSE 1 END AS pos FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def select(spark, d):
    return H.select_labels(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", ["MACHINERY", "BUILDING"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING')")
def drop(spark, d):
    return H.drop_labels(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING"])


@query("SELECT n_nationkey AS nation, n_name FROM nation")
def rename_dim(spark, d):
    return H.rename_dim(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "nation")


@query(f"WITH {CELLS} SELECT flag, part, value FROM cells")
def transpose(spark, d):
    return H.transpose(cells(spark, d), ["flag", "part"])


@query(f"WITH {CELLS} SELECT * FROM cells WHERE part IN (SELECT part FROM cells WHERE flag = 'A') AND part IN (SELECT part FROM cells WHERE flag = 'N') AND flag IN ('A', 'N')")
def concat(spark, d):
    c = cells(spark, d)
    return H.concat([c.where("flag = 'A'"), c.where("flag = 'N'")], "flag", "part")


@query("SELECT n_nationkey, c_custkey, n_name AS of_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3")
def join_inner(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return H.join_tables(c, table(spark, d, "nation").where("n_regionkey < 3"), "n_nationkey", ["n_name"], prefix="of_")


@query("SELECT c_nationkey AS n_nationkey, c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def join_left(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return H.join_tables(c, table(spark, d, "nation").where("n_regionkey < 3"), "n_nationkey", ["n_name"], "left")


@query("SELECT n_nationkey, n_regionkey, CAST(r_regionkey AS DOUBLE) AS r_regionkey, TRY_CAST(r_name AS DOUBLE) AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def annotate(spark, d):
    return H.annotate(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region"), "n_regionkey", "r_regionkey", ["r_regionkey", "r_name"])


@query("SELECT n_regionkey, n_nationkey, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
def attach_info(spark, d):
    r = table(spark, d, "region").where("r_regionkey > 1").withColumnRenamed("r_regionkey", "n_regionkey")
    return H.attach_info(table(spark, d, "nation").select("n_regionkey", "n_nationkey"), r, "n_regionkey", ["r_name"])


@query("SELECT page_id, trim(p) AS part FROM (SELECT page_id, unnest(string_split(url, '/')) AS p FROM pages) WHERE trim(p) <> ''")
def explode(spark, d):
    return H.explode_field(table(spark, d, "pages").select(F.col("page_id"), "url"), "url", "/", pos="page_id").select("page_id", "part")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def pivot(spark, d):
    return H.pivot(table(spark, d, "events"), "user_id", "event_type", labels=["click", "view"]).select("user_id", F.col("click").cast("long"), F.col("view").cast("long"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_nationkey >= 3)")
def filter_by(spark, d):
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    return H.filter_by(table(spark, d, "orders").select("o_orderkey", "o_custkey"), m, "o_custkey", [("c_acctbal", 100, 5000), ("c_nationkey", 3, None)])


@query(f"WITH {CELLS} SELECT * FROM cells WHERE part IN (SELECT part FROM cells GROUP BY 1 HAVING count(*) FILTER (value >= 250) >= 2)")
def filter_min(spark, d):
    return H.filter_min(cells(spark, d), "part", min_value=250, min_samples=2)


@query(f"WITH {HOLES} SELECT * FROM holes WHERE part IN (SELECT part FROM holes GROUP BY 1 HAVING avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.1)")
def missing(spark, d):
    return H.missing_filter(holes(spark, d), "part")


_RANK_SQL = "WITH {c}, s AS (SELECT part, {f} AS statistic FROM cells GROUP BY 1) SELECT part, round(statistic, 6) AS statistic, CAST(row_number() OVER (ORDER BY statistic {o}, part) AS INT) AS rank FROM s ORDER BY statistic {o}, part LIMIT 15"


@query(_RANK_SQL.format(c=CELLS, f="sum(value)", o="DESC"))
def rank_axis(spark, d):
    return rounded(H.rank_axis(cells(spark, d), "part", "sum", top_n=15), "statistic")


@query(_RANK_SQL.format(c=CELLS, f="max(value)", o="ASC"))
def rank_axis_ascending(spark, d):
    return rounded(H.rank_axis(cells(spark, d), "part", "max", top_n=15, descending=False), "statistic")


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC NULLS LAST, p_partkey DESC LIMIT 20")
def prioritize(spark, d):
    return H.prioritize(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", 20, "p_partkey")


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) - 1 AS new_pos FROM part")
def order_axis(spark, d):
    return H.order_axis(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", descending=True)


def _aggregate(method, sql):
    @query(f"WITH {HOLES} SELECT p_brand AS brand, flag, {sql} AS value FROM holes JOIN part ON part = p_partkey GROUP BY 1, 2")
    def run(spark, d):
        groups = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
        out = A.aggregate(holes(spark, d), groups, "part", "brand", "flag", method=method)
        return rounded(out, "value")

    name = f"aggregate_{method}"
    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


for _m, _s in {"sum": "round(coalesce(sum(value), 0), 6)", "mean": "round(avg(value), 6)", "median": "round(quantile_cont(value, 0.5), 6)", "min": "round(min(value), 6)", "max": "round(max(value), 6)", "count": "count(value)"}.items():
    _aggregate(_m, _s)


@query(f"WITH {HOLES} SELECT flag, coalesce(sum(value), 0) AS sum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 4) AS var, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median, count(*) FILTER (value <> 0) AS nonzero, count(value) AS count FROM holes GROUP BY 1")
def reduce_axis(spark, d):
    return rounded(rounded(A.reduce_axis(holes(spark, d), ["flag"]), "mean", "std"), "var", places=4)


@query(f"WITH {HOLES} SELECT count(value) AS n, count(*) - count(value) AS n_missing, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM holes")
def describe(spark, d):
    return rounded(A.describe(holes(spark, d)), "mean", "std")


@query("WITH q AS (SELECT quantile_cont(p_retailprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM part) SELECT p_partkey, CAST(len(list_filter(e, lambda x: x <= p_retailprice)) AS INT) AS bin FROM part, q")
def bin_quantile(spark, d):
    return A.bin_values(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "bin")


@query("WITH q AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT p_partkey, CAST(len(list_filter([1, 2, 3, 4, 5, 6, 7], lambda k: a + (b - a) * k / 8.0 <= p_size)) AS INT) AS bin FROM part, q")
def bin_uniform(spark, d):
    return A.bin_values(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 8, "uniform").select("p_partkey", "bin")


@query(f"WITH {HOLES}, m AS (SELECT flag, quantile_cont(value, 0.5) AS m FROM holes GROUP BY 1) SELECT part, flag, round(coalesce(value, m), 6) AS value FROM holes JOIN m USING (flag)")
def impute_median(spark, d):
    return rounded(A.impute(holes(spark, d), "flag").select("part", "flag", "value"), "value")


@query(f"WITH {HOLES} SELECT part, flag, round(coalesce(value, avg(value) OVER (PARTITION BY part), avg(value) OVER ()), 6) AS value FROM holes")
def impute_mean(spark, d):
    return rounded(A.impute(holes(spark, d), "part", method="mean").select("part", "flag", "value"), "value")


@query(f"WITH {HOLES} SELECT part, flag, coalesce(value, min(value) OVER () * 0.5) AS value FROM holes")
def impute_min(spark, d):
    return A.impute(holes(spark, d), "part", method="min", min_scale=0.5)


def _scale(name, sql, f, source=cells, places=6, with_sql=True):
    QUERIES[name] = lambda spark, d: rounded(f(source(spark, d)).select("part", "flag", "value"), "value", places=places)
    if with_sql:
        SQL[name] = f"WITH {CELLS if source is cells else HOLES} {sql}"


_scale("normalize_cpm", "SELECT part, flag, round(value / sum(value) OVER (PARTITION BY flag) * 1e6, 6) AS value FROM cells", lambda c: S.normalize(c, "flag", "part"))
_scale("normalize_total", "SELECT part, flag, round(value / sum(value) OVER (PARTITION BY flag), 9) AS value FROM cells", lambda c: S.normalize(c, "flag", "part", method="total"), places=9)
_scale("normalize_zscore", "SELECT part, flag, round((value - avg(value) OVER (PARTITION BY flag)) / stddev_pop(value) OVER (PARTITION BY flag), 6) AS value FROM cells", lambda c: S.normalize(c, "flag", "part", method="zscore"))
_scale("normalize_quantile", ", k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY value, part) AS k FROM cells), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM cells GROUP BY flag)), t AS (SELECT k, avg(value) AS t FROM k, n WHERE k <= n GROUP BY 1) SELECT part, flag, round(t, 6) AS value FROM k, n, t WHERE t.k = least(k.k, n)", lambda c: S.normalize(c, "flag", "part", method="quantile"))
_scale("normalize_median_of_ratios", ", g AS (SELECT part, avg(ln(value)) AS g FROM cells WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT flag) FROM cells)), f AS (SELECT flag, exp(quantile_cont(ln(value) - g, 0.5)) AS f FROM cells JOIN g USING (part) GROUP BY 1) SELECT part, flag, round(value / f, 6) AS value FROM cells JOIN f USING (flag)", lambda c: S.normalize(c, "flag", "part", method="median_of_ratios"))
_scale("log_transform", "SELECT part, flag, round(log2(value + 1), 6) AS value FROM holes", S.log_transform, holes)
_scale("zscore", "SELECT part, flag, round(coalesce((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END, 0), 6) AS value FROM holes WINDOW w AS (PARTITION BY flag)", lambda c: S.zscore(c, "flag"), holes)
_scale("scale_features", "SELECT part, flag, round(greatest(least((value - avg(value) OVER w) / stddev_pop(value) OVER w, 2), -2), 6) AS value FROM cells WINDOW w AS (PARTITION BY flag)", lambda c: S.scale_features(c, "flag", max_value=2.0))
_scale("min_max_scale", "SELECT part, flag, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 6) AS value FROM holes WINDOW w AS (PARTITION BY flag)", lambda c: S.min_max_scale(c, "flag"), holes)
_scale("robust_scale", ", q AS (SELECT flag, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM cells GROUP BY 1) SELECT part, flag, round((value - q[2]) / (q[3] - q[1]), 6) AS value FROM cells JOIN q USING (flag)", lambda c: S.robust_scale(c, "flag"))
_scale("softmax", ", e AS (SELECT part, flag, exp(value / 100 - max(value / 100) OVER (PARTITION BY part)) AS e FROM cells) SELECT part, flag, round(e / sum(e) OVER (PARTITION BY part), 6) AS value FROM e", lambda c: S.softmax(c.withColumn("value", F.col("value") / 100), "part"))
_scale("winsorize", ", q AS (SELECT flag, quantile_cont(value, [0.05, 0.95]) AS q FROM cells GROUP BY 1) SELECT part, flag, round(greatest(least(value, q[2]), q[1]), 6) AS value FROM cells JOIN q USING (flag)", lambda c: S.winsorize(c, "flag"))
_scale("rank_transform_average", "SELECT part, flag, rank() OVER (PARTITION BY flag ORDER BY value) + (count(*) OVER (PARTITION BY flag, value) - 1) / 2.0::DOUBLE AS value FROM cells", lambda c: S.rank_transform(c, "flag"))
_scale("rank_transform_dense", "SELECT part, flag, CAST(dense_rank() OVER (PARTITION BY flag ORDER BY value) AS DOUBLE) AS value FROM cells", lambda c: S.rank_transform(c, "flag", method="dense"))
_scale("flow_transform", "SELECT part, flag, round(asinh(1 + 0.1 * value), 6) AS value FROM cells", lambda c: S.flow_transform(c, b=0.1))

_OVERLAP = "p AS (SELECT a.id AS a_id, b.id AS b_id, a.chrom, least(a.e, b.e) - greatest(a.s, b.s) AS overlap, a.e - a.s AS na, b.e - b.s AS nb FROM a JOIN b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e)"


@query(f"WITH {INTERVALS}, {_OVERLAP} SELECT a_id, b_id, chrom, overlap, round(overlap / na, 6) AS a_fraction, round(overlap / nb, 6) AS b_fraction FROM p WHERE overlap >= 5")
def interval_overlap(spark, d):
    return I.by_row(rounded(I.overlapping(*intervals(spark, d), min_overlap=5, width=32), "a_fraction", "b_fraction"))


_MERGED = """m AS (SELECT chrom, s, e, CASE WHEN s - max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {g} THEN 0 ELSE 1 END AS new FROM {t}),
i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s, e) AS island FROM m), r AS (SELECT chrom, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY chrom, island)"""


@query(f"WITH {INTERVALS}, {_MERGED.format(t='b', g=0)} SELECT chrom, s AS start, e AS \"end\", n FROM r")
def interval_merge(spark, d):
    return I.merge(intervals(spark, d)[1])


@query(f"WITH {INTERVALS} SELECT chrom, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total, round(avg(e - s), 6) AS mean, quantile_cont(e - s, 0.5) AS median, min(e - s) AS min, max(e - s) AS max FROM a GROUP BY 1")
def interval_stats(spark, d):
    return rounded(I.interval_stats(intervals(spark, d)[0]), "mean")


@query(f"WITH {INTERVALS}, {_MERGED.format(t='b', g=0)}, g AS (SELECT chrom, e AS start, lead(s) OVER (PARTITION BY chrom ORDER BY s) AS \"end\" FROM r) SELECT *, \"end\" - start AS length FROM g WHERE \"end\" - start > 0")
def annotation_gaps(spark, d):
    return I.gaps(intervals(spark, d)[1])


@query(f"WITH {INTERVALS}, d AS (SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.s < b.e AND b.s < a.e THEN 0 WHEN b.s >= a.e THEN b.s - a.e ELSE a.s - b.e END AS distance FROM a JOIN b USING (chrom)), k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS k FROM d) SELECT a_id, b_id, distance FROM k WHERE k = 1 AND distance <= 20")
def interval_nearest(spark, d):
    return I.nearest(*intervals(spark, d), max_distance=20, width=32)


@query(f"""WITH {INTERVALS}, days AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS x FROM a), other AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS x FROM b),
n AS (SELECT (SELECT count(*) FROM days JOIN other USING (chrom, x)) AS i, (SELECT count(*) FROM days) AS p, (SELECT count(*) FROM other) AS q)
SELECT i AS intersection, p + q - i AS union, round(i / (p + q - i), 9) AS jaccard FROM n""")
def interval_jaccard(spark, d):
    return rounded(I.jaccard(*intervals(spark, d)), "jaccard", places=9)


@query(f"""WITH {INTERVALS}, {_OVERLAP}, h AS (SELECT a_id, count(*) AS hits FROM p GROUP BY 1), days AS (SELECT id AS a_id, chrom, unnest(range(s, e)) AS x FROM a), other AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS x FROM b),
c AS (SELECT a_id, count(*) AS covered FROM days JOIN other USING (chrom, x) GROUP BY 1)
SELECT id AS a_id, coalesce(hits, 0) AS hits, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / (e - s), 6) AS fraction FROM a LEFT JOIN h ON id = h.a_id LEFT JOIN c ON id = c.a_id""")
def interval_coverage(spark, d):
    return rounded(I.coverage(*intervals(spark, d), width=32), "fraction")


_FLAGS = "f AS (SELECT p_brand AS p, flag AS f, sum(value) AS v FROM cells JOIN part ON part = p_partkey GROUP BY 1, 2), x AS (SELECT a.p AS a, b.p AS b, a.v AS v, b.v AS w FROM f a JOIN f b ON a.f = b.f AND a.p < b.p)"
_DISTANCE = {"euclidean": "sqrt(sum((v - w) ** 2))", "manhattan": "sum(abs(v - w))", "cosine": "1 - sum(v * w) / sqrt(sum(v * v) * sum(w * w))", "braycurtis": "sum(abs(v - w)) / sum(v + w)"}


def _brands(spark, d):
    g = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return A.aggregate(cells(spark, d), g, "part", "brand", "flag")


def _distance(metric, sql):
    QUERIES[f"distance_{metric}"] = lambda spark, d: rounded(P.distance_matrix(_brands(spark, d), "brand", "flag", metric=metric), "distance", places=5)
    SQL[f"distance_{metric}"] = f"WITH {CELLS}, {_FLAGS} SELECT a, b, round({sql}, 5) AS distance FROM x GROUP BY 1, 2"


for _m, _s in _DISTANCE.items():
    _distance(_m, _s)

_SPARSE = "f AS (SELECT p_brand AS p, p_size AS f, 1 AS v FROM part GROUP BY 1, 2), k AS (SELECT p, count(*) AS k FROM f GROUP BY 1), x AS (SELECT a.p AS a, b.p AS b, count(*) AS c FROM f a JOIN f b ON a.f = b.f AND a.p < b.p GROUP BY 1, 2)"


@query(f"WITH {_SPARSE} SELECT m.p AS a, n.p AS b, round(1 - coalesce(c, 0) / (m.k + n.k - coalesce(c, 0)), 6) AS distance FROM k m JOIN k n ON m.p < n.p LEFT JOIN x ON x.a = m.p AND x.b = n.p")
def distance_jaccard(spark, d):
    t = table(spark, d, "part").select("p_brand", F.col("p_size").alias("f")).distinct().withColumn("value", F.lit(1.0))
    return rounded(P.distance_matrix(t, "p_brand", "f", metric="jaccard"), "distance")


def _correlate(metric, sql, source):
    QUERIES[f"correlation_{metric}"] = lambda spark, d: rounded(P.correlation(cells(spark, d), "flag", "part", metric=metric), "r")
    SQL[f"correlation_{metric}"] = f"WITH {CELLS}, f AS ({source}), x AS (SELECT a.flag AS a, b.flag AS b, a.v AS v, b.v AS w FROM f a JOIN f b ON a.part = b.part AND a.flag < b.flag) SELECT a, b, round({sql}, 6) AS r, count(*) AS n FROM x GROUP BY 1, 2"


_correlate("pearson", "corr(v, w)", "SELECT part, flag, value AS v FROM cells")
_correlate("cosine", "sum(v * w) / sqrt(sum(v * v) * sum(w * w))", "SELECT part, flag, value AS v FROM cells")


# Spearman ranks within each pair, over the features that both have; with and without missing cells
_RANKS = "x AS (SELECT a.flag AS a, b.flag AS b, a.value AS v, b.value AS w FROM {0} a JOIN {0} b ON a.part = b.part AND a.flag < b.flag WHERE a.value IS NOT NULL AND b.value IS NOT NULL), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS v, rank() OVER (PARTITION BY a, b ORDER BY w) + (count(*) OVER (PARTITION BY a, b, w) - 1) / 2.0::DOUBLE AS w FROM x)"
for _name, _with, _source, _cells in (("correlation_spearman", CELLS, "cells", cells), ("correlation_spearman_holes", HOLES, "holes", holes)):
    QUERIES[_name] = lambda spark, d, c=_cells: rounded(P.correlation(c(spark, d), "flag", "part", metric="spearman"), "r")
    SQL[_name] = f"WITH {_with}, {_RANKS.format(_source)} SELECT a, b, round(corr(v, w), 6) AS r, count(*) AS n FROM r GROUP BY 1, 2"

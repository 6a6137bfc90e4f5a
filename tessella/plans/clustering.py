"""Queries over agglomerative clustering; the SQL merges one pair at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import linkage as L
from tessella.plans.core import rounded
from tessella.plans.fixtures import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _cells(spark, d):
    """Nation by day of the week: what its customers ordered, in millions."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").cast("int").alias("nation"), (F.col("o_orderkey") % 13).alias("f")).agg((F.sum("o_totalprice") / 1e6).alias("v"))


_CELLS = (
    "c0 AS (SELECT CAST(c_nationkey AS INT) AS s, o_orderkey % 13 AS f, sum(o_totalprice) / 1e6::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), fm AS (SELECT f, avg(v) AS m FROM c0 GROUP BY 1), "
    "full_cells AS (SELECT n.s, fm.f, coalesce(v, m) AS v FROM (SELECT DISTINCT s FROM c0) n CROSS JOIN fm LEFT JOIN c0 ON c0.s = n.s AND c0.f = fm.f), "
    "d AS (SELECT x.s AS a, y.s AS b, sqrt(sum((x.v - y.v) ** 2)) AS d FROM full_cells x JOIN full_cells y ON x.f = y.f AND x.s < y.s GROUP BY 1, 2)"
)


def _merges_sql(many: int) -> str:
    """p<k>: pairs after k merges, m<k>: the k-th merge, for `many` labels."""
    out = ["p0 AS MATERIALIZED (SELECT a, b, d, 1 AS na, 1 AS nb FROM d)"]
    for k in range(1, many):
        out.append(f"m{k} AS MATERIALIZED (SELECT a, b, d, na + nb AS size FROM p{k - 1} ORDER BY d, a, b LIMIT 1)")
        side = lambda c, n, k=k: f"CASE WHEN p.{c} = m.b THEN m.a ELSE p.{c} END AS {c}, CASE WHEN p.{c} IN (m.a, m.b) THEN m.size ELSE p.{n} END AS {n}"
        out.append(f"r{k} AS (SELECT {side('a', 'na')}, {side('b', 'nb')}, p.d, p.na * p.nb AS w FROM p{k - 1} p, m{k} m WHERE NOT (p.a = m.a AND p.b = m.b))")
        out.append(f"p{k} AS MATERIALIZED (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(d * w) / sum(w) AS d, any_value(CASE WHEN a < b THEN na ELSE nb END) AS na, any_value(CASE WHEN a < b THEN nb ELSE na END) AS nb FROM r{k} GROUP BY 1, 2)")
    return ", ".join(out)


_ALL = " UNION ALL ".join(f"SELECT {k} AS step, * FROM m{k}" for k in range(1, 25))


def _clusters_sql(k: int) -> str:
    label = "s"
    steps = ["l0 AS (SELECT DISTINCT s, s AS c FROM c0)"]
    for i in range(1, 25 - k + 1):
        steps.append(f"l{i} AS MATERIALIZED (SELECT s, CASE WHEN c = m.b THEN m.a ELSE c END AS c FROM l{i - 1} LEFT JOIN m{i} m ON true)")
    return f"WITH {_CELLS}, {_merges_sql(25)}, {', '.join(steps)} SELECT {label} AS nation, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INT) AS cluster FROM l{25 - k}"


QUERIES["hierarchical_clustering"] = lambda spark, d: L.hierarchical_clustering(_cells(spark, d), "nation", "f", "v", 4)
SQL["hierarchical_clustering"] = _clusters_sql(4)
QUERIES["linkage_tree"] = lambda spark, d: rounded(L.linkage(L.distances(_cells(spark, d), "nation", "f", "v")).drop("round"), "height")
SQL["linkage_tree"] = f'WITH {_CELLS}, {_merges_sql(25)}, al AS ({_ALL}) SELECT a AS "left", b AS "right", round(d, 6) AS height, CAST(size AS BIGINT) AS size, CAST(step AS BIGINT) AS step FROM al'
QUERIES["upgma"] = lambda spark, d: rounded(L.upgma(L.distances(_cells(spark, d), "nation", "f", "v")), "length")
SQL["upgma"] = (
    f"WITH {_CELLS}, {_merges_sql(25)}, al AS ({_ALL}), e AS (SELECT a AS c, step, d FROM al UNION ALL SELECT b, step, d FROM al), g AS (SELECT c, step, d, lag(step) OVER w AS ps, lag(d) OVER w AS pd FROM e WINDOW w AS (PARTITION BY c ORDER BY step)) "
    "SELECT CASE WHEN ps IS NULL THEN CAST(c AS VARCHAR) ELSE 'node' || ps END AS node, 'node' || step AS parent, round((d - coalesce(pd, 0)) / 2, 6) AS length, ps IS NULL AS is_leaf FROM g UNION ALL SELECT 'node' || max(step), NULL, 0.0, false FROM al"
)

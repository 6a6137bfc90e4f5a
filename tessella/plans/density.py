"""Queries over clusters by density: documents by bytes and spaces of their whole texts; the SQL closes links by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators.density import dbscan
from tessella.plans.fixtures import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_EPS, _LEAST = 30, 5


def _places(spark, d):
    text = F.col("text")
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return table(spark, d, "documents").where(text.isNotNull()).select("doc_id", F.array(F.octet_length(text), 4 * spaces).alias("place"))


QUERIES["dbscan"] = lambda spark, d: dbscan(_places(spark, d), "doc_id", "place", _EPS, _LEAST)
SQL["dbscan"] = (
    "WITH RECURSIVE d AS (SELECT doc_id, strlen(text) AS x, 4 * (strlen(text) - strlen(replace(text, ' ', ''))) AS y FROM documents WHERE text IS NOT NULL), p AS MATERIALIZED (SELECT x, y, count(*) AS n, min(doc_id) AS f FROM d GROUP BY 1, 2), "
    f"near AS MATERIALIZED (SELECT a.x, a.y, a.f, b.f AS g, b.n FROM p a JOIN p b ON b.x BETWEEN a.x - {_EPS} AND a.x + {_EPS} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS * _EPS}), "
    f"core AS MATERIALIZED (SELECT f FROM near GROUP BY f HAVING sum(n) >= {_LEAST}), links AS MATERIALIZED (SELECT f, g FROM near WHERE f IN (FROM core) AND g IN (FROM core) AND f <> g), "
    "reach AS (SELECT f, f AS g FROM core UNION SELECT reach.f, links.g FROM reach JOIN links ON reach.g = links.f), least AS (SELECT f, min(g) AS r FROM reach GROUP BY f), named AS (SELECT f, dense_rank() OVER (ORDER BY r) - 1 AS c FROM least), "
    "border AS (SELECT near.f, min(c) AS c FROM near JOIN named ON near.g = named.f WHERE near.f NOT IN (FROM core) GROUP BY near.f) "
    "SELECT d.doc_id, CAST(coalesce(named.c, border.c, -1) AS INT) AS cluster, named.c IS NOT NULL AS core FROM d JOIN p USING (x, y) LEFT JOIN named ON named.f = p.f LEFT JOIN border ON border.f = p.f"
)

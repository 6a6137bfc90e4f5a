"""Queries over penalised regression and gene sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import gene_sets as G
from tessella.operators import penalised as P
from tessella.operators.linkage import distances
from tessella.operators.mixed import linear_mixed_model
from tessella.operators.permutations import mantel, permanova
from tessella.plans.core import rounded
from tessella.plans.fixtures import CELLS, cells, table
from tessella.plans.regression import _CUST, _cust

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name, f, sql=None, places=6):
    QUERIES[name] = lambda spark, d: (lambda df: rounded(df, *[c for c, t in df.dtypes if t == "double"], places=places))(f(spark, d))
    if sql:
        SQL[name] = sql


# --- penalised: a customer's spending by orders and balance; five folds by key, and all rows as fold -1

_ST = _CUST + ", fs AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS f), st AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(z) AS sz, corr(x, z) AS r, covar_pop(x, y) / stddev_pop(x) AS c1, covar_pop(z, y) / stddev_pop(z) AS c2 FROM fs JOIN cu ON k % 5 <> f GROUP BY 1)"


def _descent(alpha: float, l1: float, rounds: int = 300) -> str:
    soft = lambda v: f"(sign({v}) * greatest(abs({v}) - {alpha * l1}, 0) / {1 + alpha * (1 - l1)})"
    one = soft("c1 - r * w2")
    return f"it AS (SELECT f, 0 AS i, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM st UNION ALL SELECT it.f, i + 1, {one}, {soft(f'c2 - r * {one}')} FROM it JOIN st ON it.f = st.f WHERE i < {rounds}), w AS (SELECT f, w1, w2 FROM it WHERE i = {rounds})"


def _fit_sql(weights: str) -> str:
    return (
        f"WITH RECURSIVE {_ST}, {weights}, b AS (SELECT st.*, w1, w2, w1 / sx AS b1, w2 / sz AS b2, my - mx * w1 / sx - mz * w2 / sz AS b0 FROM st JOIN w USING (f)), "
        "t AS (SELECT f, 1 - sum((y - b0 - b1 * x - b2 * z) ** 2) / (var_pop(y) * count(*)) AS r2 FROM b JOIN cu ON k % 5 = f GROUP BY 1), cv AS (SELECT avg(r2) AS m, stddev_pop(r2) AS s FROM t) "
        "SELECT feature, round(coef, 5) AS coef, round(slope, 5) AS slope, round(b0, 5) AS intercept, n, round(m, 5) AS cv_mean, round(s, 5) AS cv_std FROM (SELECT 'x' AS feature, w1 AS coef, b1 AS slope, b0, n FROM b WHERE f = -1 UNION ALL SELECT 'z', w2, b2, b0, n FROM b WHERE f = -1), cv"
    )


def _penalised(fit, **more):
    def run(spark, d):
        rows = _cust(spark, d)
        return fit(rows, "k", "y", ["x", "z"], folds=5, fold=F.col("k") % 5, **more)

    return run


_add("ridge_regression", _penalised(P.ridge, alpha=10.0), _fit_sql("w AS (SELECT f, (c1 * (1 + 10.0 / n) - r * c2) / ((1 + 10.0 / n) ** 2 - r * r) AS w1, (c2 * (1 + 10.0 / n) - r * c1) / ((1 + 10.0 / n) ** 2 - r * r) AS w2 FROM st)"), 5)
_add("lasso_regression", _penalised(P.lasso, alpha=0.01), _fit_sql(_descent(0.01, 1.0)), 5)
_add("elastic_net_regressor", _penalised(P.elastic_net, alpha=0.05, l1_ratio=0.5), _fit_sql(_descent(0.05, 0.5)), 5)

# --- gene sets: parts are genes, brands their sets


def _sets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))


_add(
    "ssgsea",
    lambda spark, d: G.ssgsea(cells(spark, d), _sets(spark, d), "part", "flag", "value", "brand"),
    f"WITH {CELLS}, r AS (SELECT flag AS sample, part, CAST(floor(rank() OVER (PARTITION BY flag ORDER BY value) + (count(*) OVER (PARTITION BY flag, value) - 1) / 2.0) AS BIGINT) AS r FROM cells WHERE value IS NOT NULL), "
    "p AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY r DESC, part) AS place FROM r), s AS (SELECT sample, p_brand AS set_name, max(n) AS n, count(*) AS k, sum(r::DOUBLE ** 0.25) AS w, sum(r::DOUBLE ** 0.25 * (n - place + 1)) AS ws, sum(n - place + 1) AS b FROM p JOIN part ON part = p_partkey GROUP BY 1, 2), "
    "e AS (SELECT sample, set_name, ws / w - (n * (n + 1) / 2 - b) / (n - k) AS score FROM s WHERE k < n) SELECT sample, set_name AS \"set\", round(score / (SELECT max(score) - min(score) FROM e), 6) AS score FROM e",
)
# p counts permutations of a stream of its own: held against brute force in the tests
_add("gsea", lambda spark, d: G.gsea(cells(spark, d).groupBy("part").agg((F.sum(F.when(F.col("flag") == "R", F.col("value"))) - F.sum(F.when(F.col("flag") == "A", F.col("value")))).alias("v")), _sets(spark, d), "part", "v", "brand", permutations=100))

# --- mixed models and permutations; the first has no closed form, the p of the others a stream of its own: held against brute force
_add("linear_mixed_model", lambda spark, d: linear_mixed_model(_spent(spark, d), "price", ["age", "status"], "customer", ("status",)), places=4)
_add("permanova", lambda spark, d: permanova(_profiles(spark, d), table(spark, d, "nation"), "n_nationkey", "n_regionkey", 199))
_add("mantel", lambda spark, d: mantel(_profiles(spark, d), _profiles(spark, d, shift=1), 199))


def _spent(spark, d):
    """Orders: price in thousands, the order's day in years and its status, by customer."""
    o = table(spark, d, "orders")
    return o.select((F.col("o_totalprice") / 1000).alias("price"), (F.unix_date(F.to_date("o_orderdate")) / 365.25).alias("age"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))


def _profiles(spark, d, shift: int = 0):
    """Distances of nations by what their customers ordered in thirteen kinds of orders, or in thirteen and `shift`."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return distances(o.groupBy(F.col("c_nationkey").alias("n"), (F.col("o_orderkey") % (13 + shift)).alias("f")).agg((F.sum("o_totalprice") / 1e6).alias("v")), "n", "f", "v")

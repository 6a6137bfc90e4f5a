"""Every query with SQL against DuckDB, on the smallest tables or those in $ORACLE_DIR."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[i] for i in order)))
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    want = normal(cur.fetchall(), names)
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want) and want
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)), (name, g, w)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())

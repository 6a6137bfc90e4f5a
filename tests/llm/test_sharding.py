import random
import zlib

import pytest

from tessella.llm.sharding import shard, splitters


def made(seed, hot=0):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.choice([0, 5, 50, 400])))) for i in range(1500)]
    rows += [(5000 + i, "hot " * 30) for i in range(hot)] + [(9000, None), (9001, ""), (None, None), (3, rows[3][1]), (3, rows[3][1])]
    rnd.shuffle(rows)
    return rows


def judge(got, rows, shards, near, together=True):
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(rows, key=str)
    by, homes = {}, {}
    for r in got:
        b = (r.text or "").encode()
        assert r._shard.size == len(b) + 1 and r._shard.text_crc32 == zlib.crc32(b)
        by.setdefault(r._shard.shard, []).append(r._shard)
        homes.setdefault(b, set()).add(r._shard.shard)
    for s in by.values():
        assert sorted(x.slot for x in s) == list(range(len(s)))
    if together:
        assert all(len(h) == 1 for h in homes.values())
    sizes = [sum(x.size for x in by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= near * sum(sizes) / shards, sizes


@pytest.mark.parametrize("shards,hot,together", [(8, 0, True), (3, 300, True), (8, 3000, False), (1, 10, True)])
def test_bytes_near_equal(spark, shards, hot, together):
    rows = made(shards, hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    judge(shard(df, shards, 0.01, bin_bytes=20000).collect(), rows, shards, 0.06, together)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 2])
def test_rows_that_nothing_tells_apart(spark, ids):
    rows = [(ids(i), "one text") for i in range(10_000)] + [(i, f"other {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    judge(shard(df, 8, 0.01).collect(), rows, 8, 0.02, together=False)


def test_groups_of_many_rows_are_numbered_by_place(spark):
    rows = [(None, f"text {i % 7}") for i in range(3000)] + [(i, f"other {i}") for i in range(3000)]
    judge(shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 0.3, group_rows=100).collect(), rows, 4, 0.4)


def test_edges(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = shard(spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, shard string")).collect()
    assert len(one) == 1 and one[0].shard == "x" and one[0]._shard.slot == 0


def test_splitters_are_exact(spark):
    keys = spark.createDataFrame([(i * 1000, 10) for i in range(-500, 500)], "key long, bytes long")
    cuts = splitters(keys, [2500, 5000, 7500], 10)
    assert [sum(10 for i in range(-500, 500) if i * 1000 < c) for c in cuts] == [2500, 5000, 7500]


def test_whole_table(spark):
    from tessella.llm.queries import op7_sharding

    d = "/root/testdata/sf0.001"
    rows = op7_sharding(spark, d).collect()
    assert len(rows) == 200 and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    sizes = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(8))
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows) + 0.01 * sum(sizes) / 8, sizes

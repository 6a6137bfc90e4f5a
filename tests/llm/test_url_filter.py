import re

import pytest

from tessella.llm.url_filter import Rule, _filed, host_path_rule, url_filter, word_rule

URLS = [
    None, "", "no scheme", "http://", "https://COM/en/1", "http://a.example.com/en/7", "http://example.com/en/75?x=/en/", "http://example.com/en/8#top",
    "http://notexample.com/en/7", "http://x.example.net/de/8", "http://example.net/de/9", "http://example.org/es/", "ftp://example.org/ES/", "http://example.org?q=/es/",
    "http://example.org#/es/", "a://b://c.com/en/", "http://cheap-pills.example.com/fr/1", "http://example.com/fr/cheap-pills", "http://example.com/fr/cheap-pillsx", "http://é.com/en/ß", "http://h.net/en/" + "x" * 50000,
]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "h.net", "/en/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[1:])
    spam = re.search(r"(^|[^a-z0-9])cheap[^a-z0-9]pills([^a-z0-9]|$)", f"{host} {path}".lower())
    return host, path, None, "block" if spam else "allow"


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS * 3)], "page_id long, url string, rule string")
    got = url_filter(df, [host_path_rule(*r) for r in RULES] + [word_rule("block", "cheap-pills")]).collect()
    assert len(got) == 3 * len(URLS) and all(r.rule == "kept" for r in got)
    for r in got:
        assert (r._url.host, r._url.path, r._url.rule, r._url.verdict) == brute(r.url), r.url


def test_rules_are_filed_under_their_rarest_token(spark):
    assert [e["t"] for e in _filed([host_path_rule("block", "rare.com", "/en/")], {"com": 21, "en": 21, "rare": 1})] == ["rare"]
    assert [e["t"] for e in _filed([Rule("any", "block", ".*", (), 0)], {})] == [""]
    df = spark.createDataFrame([(f"http://example.com/en/{i}",) for i in range(20)] + [("http://rare.com/en/",)], "url string")
    plan = url_filter(df, [host_path_rule("block", "rare.com", "/en/")])._jdf.queryExecution().optimizedPlan().toString()
    assert "[rare," in plan and "from_json" not in plan and "Join" not in plan


@pytest.mark.parametrize("limits", [{}, {"index_bytes": 0}, {"index_bytes": 0, "broadcast_bytes": 0}])
def test_spaces_and_case_on_every_way(spark, limits):
    more = ["http://foo.de/a.com /en/7", "http://a.com /en/7", "http://a.com\n/en/7", "http://foo.de/x com/en/", "http://foo.de/CHEAP-pills", "http://Cheap-Pills.de", "http://foo.de/Cheap/pills/", "http://example.ORG/Es/", "http://a.spam/cheap", "http://x.cheap/pills"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate((URLS + more) * 2)], "page_id long, url string")
    got = url_filter(df, [host_path_rule(*r) for r in RULES] + [word_rule("block", "cheap-pills")], **limits).collect()
    assert len(got) == 2 * len(URLS + more)
    for r in got:
        assert (r._url.host, r._url.path, r._url.rule, r._url.verdict) == brute(r.url), r.url


@pytest.mark.parametrize("limits", [{}, {"index_bytes": 0}])
def test_twenty_thousand_rules(spark, limits):
    rules = [host_path_rule("block" if i % 3 else "allow", f"h{i}.com", f"/p{i % 7}/") for i in range(20_000)]
    urls = [f"http://www.h{i}.com/p{i % 5}/x" for i in range(0, 20_000, 40)] + ["http://h1.com", "http://xh7.com/p0/"]
    fits = {f"h{i}.com/p{i % 7}/": "block" if i % 3 else "allow" for i in range(20_000)}
    for r in url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), rules, "none", **limits).collect():
        name = r._url.host.removeprefix("www.") + r._url.path.removesuffix("x")
        assert (r._url.rule, r._url.verdict) == ((name, fits[name]) if name in fits and r._url.path else (None, "none")), r.url


def test_edges(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r._url.verdict for r in url_filter(df, [], "block").collect()} == {"block"}
    assert url_filter(df.limit(0), [host_path_rule(*RULES[0])]).count() == 0
    every = url_filter(df, [Rule("any", "block", ".*", (), 0)]).collect()
    assert {r._url.rule for r in every} == {"any"}


def test_whole_table_against_sql(spark):
    import duckdb

    from tessella.llm.queries import oracle_sql, op8_url_filter

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = sorted(con.execute(oracle_sql()["op8_url_filter"]).fetchall())
    assert sorted(tuple(r) for r in op8_url_filter(spark, d).collect()) == want and len(want) == 50


def test_word_rules_in_any_case(spark):
    spam = ["http://a.org/Casino/", "http://a.org/x/CHEAP-PILLS", "http://CASINO.org/", "http://b.org/fr/cheap_Pills?x", "http://a.org/\u212aasino/casino"]
    ham = ["http://a.org/Casinos/", "http://a.org/CHEAP/PILL", "http://example.org/ES/"]
    rules = [host_path_rule("block", "org", "/es/"), host_path_rule("allow", "b.org", "/FR/"), word_rule("block", "cheap-pills"), word_rule("block", "casino")]
    df = spark.createDataFrame([(u,) for u in spam + ham], "url string")
    got = {r.url: (r._url.rule, r._url.verdict) for r in url_filter(df, rules).collect()}
    assert all(got[u] == (None, "block") for u in spam) and all(got[u] == (None, "allow") for u in ham)


def test_mixed_case_paths_against_sql(spark, tmp_path):
    import duckdb

    from tessella.llm.queries import oracle_sql, op8_url_filter

    paths = ["/Casino/", "/EN/1", "/en/Poker", "/x/CHEAP-PILLS", "/Viagra.HTML", "/casino", "/ES/Free_Money", "/Adults"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.org", "Example.com", "SPAM-farm.net", "x.io") for p in paths)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(oracle_sql()["op8_url_filter"]).fetchall())
    assert sorted(tuple(r) for r in op8_url_filter(spark, str(tmp_path)).collect()) == want


def test_rules_of_the_query_are_those_of_its_contract(spark, tmp_path):
    from tessella.llm.queries import op8_url_filter

    urls = {"http://a.net/de/1": ("net/de/", "allow"), "http://casino.net/de/casino": ("net/de/", "allow"), "http://x.example.net/de/8": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow")}
    urls |= {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/75": ("example.com/en/7", "allow"), "http://a.org/es/": ("org/es/", "block")}
    rows = list(enumerate(urls))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: urls[u] for i, u in rows}

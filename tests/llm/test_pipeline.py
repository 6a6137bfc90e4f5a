import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard_join import brute as brute_groups
from tests.llm.test_substring_dedup import brute as brute_repeats
from tests.llm.test_tokens import check_pieces, ids_of


def test_each_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in p.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, d)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        rows = docs.collect()
        pairs = [(i, r.text) for i, r in before.items()]
        if name == "packing":
            check_pieces(rows, pairs, ids_of("byte_bpe_50k.json", 1), 2048)
            continue
        assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        after = {r.doc_id: r for r in rows}
        kept.append(len(after))
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, _, c in brute_groups(pairs, 5, 75) if i == c}
        elif name == "substring_dedup":
            gone = {i: n for i, _, n, _ in brute_repeats(pairs, 50)}
            assert set(after) == set(before)
            assert all(len((before[i].text or "").split()) - len((after[i].text or "").split()) == n for i, n in gone.items())
            assert all(after[i] == before[i] for i, n in gone.items() if not n)
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            assert set(after) == {i for i, _, n, _ in brute_hits(pairs, items, 10) if not n}
        if name != "substring_dedup":
            assert all(after[i] == before[i] for i in after)
    assert kept[0] < 200 and kept[1] < kept[0] and kept[3] < kept[2]


def test_run(spark):
    import corpus_pipeline as p

    out = p.run(spark, "/root/testdata/sf0.001")
    assert out.agg(F.sum("length")).first()[0] > 0
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_odd_rows(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "The and attion to thanedble the, anea. Eriner thanea and of that. It was er."
    rows = [(1, text, "en", None, 5), (2, text, None, "a", None), (None, text, "en", "a", 1), (3, None, "en", "a", 1), (4, "", "en", "a", 1), (1, text, "en", "a", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted([(r.doc_id, r.text) for r in docs.collect()], key=str) == (sorted([(1, text), (None, text)], key=str) if data else [])


def test_rows_of_one_id_and_unlike_texts(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, b + " end", "x"), (3, c, "x"), (None, a, "x"), (4, None, "x"), (4, None, "x"), (5, c + " end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in p.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a, "x"), (1, b, "x"), (3, c, "x"), (None, a, "x"), (4, None, "x")], key=str)

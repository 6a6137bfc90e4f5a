import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm.weak_labels import LABELLERS, Measures, expectation_maximisation, judge, train

PROSE = ["The and attion to thanedble the, anea. Eriner thanea and of that. Inonsh ster thntored haesat, er a rereer this.", "Ononing er was it heer and thorre the onant. That is ha ble tion."]


def measure(text):
    m = Measures(pa.array([text], pa.string()))
    return {lab.name: v[0] for lab, v in zip(LABELLERS, m.values, strict=True)}, dict(zip([lab.name for lab in LABELLERS], m.votes()[:, 0], strict=True))


def test_measures():
    x, v = measure("Hello hello WORLD you idiot |  |\nscum scum")
    assert x["capitals"] == 6 / 31 and x["stutter"] == pytest.approx(3 / 9) and x["lone_symbols"] == pytest.approx(2 / 9)
    assert (x["insults_a"], x["insults_b"], x["insult_kinds"]) == (2, 1, 2) and v["insults_a"] == -1 and v["symbols"] == 0
    assert measure("foo%%% bar### baz&&&")[1]["marked_words"] == -1
    assert measure("a b\n" * 9)[0]["same_lines"] == pytest.approx(8 / 9)
    for empty in ("", " \n", None):
        assert measure(empty)[1]["symbols"] == -1


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((20000, 4)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = expectation_maximisation(patterns, counts, np.ones(4) * 0.3)
    assert model.prior == pytest.approx(0.7, abs=0.05)
    assert np.allclose(model.chance[:, 1, 1], right, atol=0.06)
    assert ((model.posterior(patterns)[of.ravel()] > 0.5) == good).mean() > 0.9


def test_scorer_learns():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(1000, 5000, 30)) for _ in range(600)]
    y = np.array([float(i % 3 == 0) for i in range(600)])
    rows = [np.append(r, 7 if t else 8) for r, t in zip(rows, y, strict=True)]
    w = train(rows, y)
    assert np.mean([(w[r].sum() > 0) == bool(t) for r, t in zip(rows, y, strict=True)]) == 1
    assert not train([], np.zeros(0)).any()


def test_edges(spark):
    rows = [(i, " ".join(random.Random(i).choice(PROSE) for _ in range(3)), "x") for i in range(200)]
    rows += [(300 + i, "JUNK!! " * (30 + i), None) for i in range(30)] + [(400 + i, PROSE[0] + " you stupid idiot, scum", "y") for i in range(20)]
    rows += [(500, None, "z"), (501, "", "z"), (None, PROSE[0], "z"), (None, None, None), (5, rows[5][1], "x"), (502, PROSE[1] * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    got = {(r.doc_id, r.text): r._quality.keep for r in judge(df).collect()}
    assert all(got[i, t] for i, t, _ in rows[:200]) and not any(got[i, t] for i, t, _ in rows[200:250])
    assert not got[500, None] and not got[501, ""] and got[None, PROSE[0]] and got[502, PROSE[1] * 3000]
    assert judge(df).count() == len(rows) and "quality" in judge(df).columns
    none = spark.createDataFrame([], "doc_id long, text string")
    assert judge(none).count() == 0 and judge(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_held_out_labels(spark):
    from tessella.llm.queries import op4_quality_classifier

    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    kept = {r.doc_id: r.keep for r in op4_quality_classifier(spark, d).collect()}
    assert len(kept) == 1000
    clean = [kept[i] for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    junk = [kept[i] for i, r in labels.items() if r.quality == 0]
    toxic = [kept[i] for i, r in labels.items() if r.toxic == 1 and lang[i] == "en"]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05 and np.mean(toxic) < 0.05


def test_stems_of_few_documents(spark):
    from tessella.llm.weak_labels import _HEADS, _TRIMMED, mine_stems, text_bytes

    def head(word):
        return int(_TRIMMED(*text_bytes(pa.array([word])))[4][_HEADS.index(6)][0])

    rng = random.Random(3)
    fill = lambda: " ".join("".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(20))
    texts = [(fill() + " zorgblats" * 3, 1) for _ in range(900)] + [(fill() + " achlicho achlicha" * 2, 1) for _ in range(4)] + [(fill() + " common", i % 9 == 0) for i in range(900)]
    texts += [("achlicho " * 20 + fill(), 0), ("onceonly " * 50 + fill(), 1)] + [("samesame " * 9, 1)] * 12
    rows = [(i, t, int(bad)) for i, (t, bad) in enumerate(texts)] + [(0, texts[0][0], 1), (None, "achlicho " * 99, 0), (9999, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for part in (df, df.where("doc_id >= 900")):  # the four are below 1 % of the toxic ones, or too few for a fixed share
        stems = mine_stems(part, part, "doc_id", "text")
        assert head("achlicho") not in stems.likely  # its other use is as heavy
    df = df.where("text not like 'achlicho achlicho%' or text is null")
    for part in (df, df.where("doc_id >= 900")):
        stems = mine_stems(part, part, "doc_id", "text")
        assert head("achlicho") in stems.likely and not any(head(w) in stems.likely for w in ("common", "onceonly", "samesame"))
        assert (head("zorgblats") in stems.sure) == (part is df)


def test_sample_is_never_empty(spark):
    junk = spark.createDataFrame([(None, "J@NK## %% " * 40)] * 300, "doc_id long, text string")
    assert not any(r._quality.keep for r in judge(junk, sample=4).collect())


@pytest.mark.parametrize("sf, most", [("sf0.001", 0), ("sf0.01", 4)])
def test_insults_of_all_languages(spark, sf, most):
    from tessella.llm.queries import op4_quality_classifier

    d = f"/root/testdata/{sf}"
    toxic = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id")
    assert op4_quality_classifier(spark, d).join(toxic, "doc_id").where("keep").count() <= most

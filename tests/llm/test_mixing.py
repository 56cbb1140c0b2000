import random

import numpy as np
import pytest
from llm.odd import empty_docs, odd_docs, odd_rows, stored
from pyspark.sql import functions as F

from storeloom.llm import mixing

BAD = ["vile", "nasty", "awful"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(1)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        kind = ("clean", "clean", "clean", "poor", "toxic")[i % 5]
        text = random.choices(words, k=random.randint(5, 60))
        if kind == "toxic":
            text += random.choices(BAD, k=3)
        if kind == "clean":
            text += random.choices(["plain", "kind", "sound"], k=4)
        if kind == "poor":
            text = [w + "###" for w in text]
        random.shuffle(text)
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    folder = tmp_path_factory.mktemp("mix")
    return (
        stored(spark, folder / "d", docs),
        stored(spark, folder / "l", labels, "doc_id long, quality int, toxic int"),
        docs,
    )


def plain_rates(soft, share, rounds=20_000):
    """Projected gradient on all rates at once, tiny steps, same metric."""
    p, n = soft
    tokens = (n[:, None] * p).sum(0)
    goal = share * tokens[0] / share[0]
    moments = (n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0)
    inverse = np.linalg.pinv(moments)
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(0, r - 0.5 * p @ (inverse @ ((n[:, None] * p * r[:, None]).sum(0) - goal)))
    return r, goal


def test_rates_meet_the_targets_and_equal_a_plain_fit(corpus):
    docs, labels, rows = corpus
    got = mixing.mix(docs, labels).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    p = np.array([[r.p_clean, r.p_poor, r.p_toxic] for r in got])
    n = np.array([r.n_tokens for r in got], float)
    assert np.abs(p.sum(1) - 1).max() < 1e-5
    r = np.array([r.rate for r in got])
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    want, goal = plain_rates((p, n), share)
    assert np.abs((n[:, None] * p * r[:, None]).sum(0) - goal).max() < 1e-4 * goal.sum()
    assert np.abs(r - want).max() < 1e-2 and (r >= 0).all()
    assert got[0].miss < 1e-5
    assert all(abs(x.copies - x.rate) < 1 for x in got)
    assert sum(x.copies for x in got) == pytest.approx(r.sum(), rel=0.1)


def test_classifier_on_documents_without_label(corpus):
    docs, labels, rows = corpus
    model = mixing.fit_domains(docs, labels)
    got = mixing.with_posteriors(docs, model).collect()
    for r in got:
        kind = ("clean", "clean", "clean", "poor", "toxic")[r.doc_id % 5]
        best = max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"])
        assert best == kind
    assert {r.n_tokens for r in got} == {len(t.split()) for _, t in rows}


def test_targets_out_of_reach_end_with_bounded_rates(corpus):
    docs, labels, _ = corpus
    soft = mixing.with_posteriors(docs, mixing.fit_domains(docs, labels)).cache()
    steps = mixing.fit_rates(soft, {"clean": 1.0, "poor": 0.0, "toxic": 0.0})
    low, high = soft.select(mixing.rate(steps).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert low >= 0 and high < 3
    # Every document is to some part poor or toxic, so the fit misses, and says so.
    assert steps.miss > 1e-4 and steps.wanted["toxic"] == 0 < steps.expected["toxic"]
    kept = mixing.rate(mixing.fit_rates(soft, keep_from=0.5), 0.5)
    assert soft.filter("p_clean >= 0.5").filter(kept < 1).count() == 0


def test_take_keeps_rows_as_they_are(corpus):
    docs, labels, rows = corpus
    got = mixing.take_mixed(docs.withColumn("p_clean", F.lit("mine")), labels)
    assert got.columns == ["doc_id", "text", "p_clean"]
    texts = dict(rows)
    found = got.collect()
    assert all(texts[r.doc_id] == r.text and r.p_clean == "mine" for r in found)
    ids = {r.doc_id for r in found}
    assert len(ids) == len(found)
    assert all(i in ids for i, _ in rows if i % 5 < 3)
    assert sum(i in ids for i, _ in rows if i % 5 == 4) < 120


def test_odd_documents_and_labels(spark, tmp_path):
    df = odd_docs(spark, tmp_path / "d")
    schema = "doc_id long, quality int, toxic int"
    for n, labels in enumerate(([], [(0, 1, 0), (3, None, 1), (None, 0, 0), (6, 0, 1), (6, 1, 0)])):
        got = mixing.mix(df, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(odd_rows())
        assert all(r.rate >= 0 for r in got)
    none = spark.createDataFrame([], schema)
    assert mixing.mix(empty_docs(spark, tmp_path / "e"), none).collect() == []
    assert mixing.take_mixed(empty_docs(spark, tmp_path / "f"), none).collect() == []
    assert mixing.take_mixed(df, none).columns == df.columns


def test_rare_words_and_word_starts_tell_toxic_documents(spark, tmp_path):
    """A word of twelve labelled documents, all toxic, tells; so do inflected forms of one."""
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = random.choices(words, k=30)
        if i % 40 == 0:
            text.append("\u201erare\u201c, \"rarity\"!")
        if i % 40 == 1:
            text.append(f"abscheu{'lich' * (1 + i % 3)}{chr(97 + i // 40)}.")
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 40 < 2)))
    docs += [(1000, "w1 w2 w3 (rarity)"), (1001, "w4 w5 w6 Abscheulichste"), (1002, "w7 w8 w9")]
    df = stored(spark, tmp_path / "d", docs)
    model = mixing.fit_domains(df, stored(spark, tmp_path / "l", labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.p_toxic for r in mixing.with_posteriors(df.filter("doc_id >= 1000"), model).collect()}
    assert got[1000] >= model.toxic_from and got[1001] >= model.toxic_from
    assert got[1002] < model.toxic_from


def test_recognised_toxic_documents_go_also_where_they_are_one_in_a_hundred(spark, tmp_path):
    random.seed(7)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(2000):
        text = random.choices(words, k=20) + (random.choices(BAD, k=3) if i % 100 == 0 else [])
        docs.append((i, " ".join(text)))
        if i % 200 < 160:
            labels.append((i, 1, int(i % 100 == 0)))
    df = stored(spark, tmp_path / "d", docs)
    known = stored(spark, tmp_path / "l", labels, "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in mixing.take_mixed(df, known).collect()}
    assert not [i for i in ids if i % 100 == 0]
    assert len(ids) >= 0.98 * 1980

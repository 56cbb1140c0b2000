import random
import re

import numpy as np
import pytest
from llm.odd import LONG, empty_docs, odd_docs, odd_rows, stored

from storeloom.llm import ordinal, quality_forest as qf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(words) < 3000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)} if often is not None else None
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup,
            None if covered is None else len(covered)]


def test_base_statistics_of_odd_texts():
    random.seed(3)
    texts = [t for _, t in odd_rows() if t != LONG and t != LONG + "x"]
    texts += [" ".join(random.choices("ab", k=n)) for n in range(40)]
    texts += ["a b c d e " * 3, "\xa0x\xa0 y z", "\x1c \x85 \x00", "a\x0bb\x0cc\rd"]
    for t in texts:
        assert qf.statistics(t)[0] == plain(t)


def test_long_texts_by_sorting_give_the_same():
    random.seed(4)
    for n in (5, 6, 20, 3000):
        words = [w.encode() for w in random.choices([f"w{i}" for i in range(12)], k=n)]
        assert qf._repeat_words_sorted(words) == qf.repeat_words(words)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    random.seed(9)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(1200):
        text = random.choices(words, k=random.randint(12, 80))
        poor, toxic = i % 7 == 0, i % 9 == 0
        if poor:
            text = [w + "$$$" if random.random() < 0.8 else w for w in text]
        if toxic:
            text += ["vilewordx", "nastywordy"]
        docs.append((i, " ".join(text) + "."))
        labels.append((i, int(not poor), int(toxic)))
    folder = tmp_path_factory.mktemp("quality")
    held = labels[::2]
    return (
        stored(spark, folder / "d", docs),
        stored(spark, folder / "l", held, "doc_id long, quality int, toxic int"),
        docs,
        labels,
    )


def test_forest_on_documents_without_label(labelled):
    docs, labels, rows, truth = labelled
    got = {r.doc_id: r for r in qf.quality_rules(docs, labels).collect()}
    for (i, text), (_, quality, _) in zip(rows, truth):
        assert [got[i][c] for c in qf.BASE] == plain(text)
    poor = [i for i, q, _ in truth if not q and i % 2]
    good = [i for i, q, _ in truth if q and i % 2]
    assert np.mean([got[i].kept for i in poor]) < 0.05
    assert np.mean([got[i].kept for i in good]) > 0.98


def test_forest_paths_isolate_outliers():
    rng = np.random.default_rng(2)
    rows = np.abs(rng.normal(0, 1, (600, len(qf.RATIOS))))
    rows[:30, 0] += 20
    good = np.arange(600) >= 30
    forest = qf.fit(rows, good)
    scores = qf.anomaly(forest, rows)
    assert scores[:30].min() > np.quantile(scores[30:], 0.95)
    assert (scores > 0).all() and (scores < 1).all()
    assert qf.calibrate(scores, np.ones(600, bool)) == np.inf
    assert qf.fit(rows, np.zeros(600, bool)) is None


def test_grades_on_documents_without_label(labelled):
    docs, labels, _, truth = labelled
    got = {r.doc_id: r for r in ordinal.grade_documents(docs, labels).collect()}
    by = {}
    for i, q, t in truth:
        if i % 2:
            by.setdefault(q + 1 - t, []).append(got[i])
    means = [np.mean([r.expected_grade for r in by[g]]) for g in sorted(by)]
    assert means == sorted(means) and means[-1] > 1.8
    assert np.mean([r.kept for r in by[2]]) > 0.95
    assert np.mean([r.kept for r in by[1]]) < 0.1
    assert all(0 <= r.p_top <= 1 and r.expected_grade >= r.p_top for r in got.values())


def test_cuts_are_ordered():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(600)]
    grades = np.array([min(2, int((d < 12).sum()) // 2) for d in docs])
    model = ordinal.fit(docs, grades)
    assert (np.diff(model.cuts) > 0).all()
    tails = ordinal.tails(model.cuts, ordinal._sums(model.weights, docs))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(1), grades)[0, 1] > 0.7


@pytest.mark.parametrize("apply", [qf.quality_rules, ordinal.grade_documents])
def test_odd_documents_and_labels(spark, tmp_path, apply):
    df = odd_docs(spark, tmp_path / "d")
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(0, 1, 0), (3, None, 1), (None, 0, 0), (6, 0, 1), (6, 1, 0), (9, 1, 1), (12, 0, 0)]):
        got = apply(df, spark.createDataFrame(labels, schema))
        assert len(got.collect()) == len(odd_rows())
        # The input's column ``kept`` is replaced, all others stay as they are.
        assert got.schema["kept"].dataType.simpleString() == "boolean"
        assert {r._doc for r in got.select("_doc").collect()} == {"x"}
    none = spark.createDataFrame([], schema)
    assert apply(empty_docs(spark, tmp_path / "e"), none).collect() == []

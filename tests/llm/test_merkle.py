import random

import pytest
from llm.odd import empty_docs, odd_docs, odd_rows, sha, stored
from pyspark.sql import functions as F

from storeloom.llm.merkle import edit_span, edit_trace, fingerprints, following, with_tree


def test_odd_documents(spark, tmp_path):
    got = edit_trace(odd_docs(spark, tmp_path / "d")).collect()
    assert len(got) == len(odd_rows())
    texts = {}
    for i, t in odd_rows():
        texts.setdefault(-(2**63) if i is None else i, []).append(t or "")
    ids = sorted(texts, reverse=True)
    after = {a: ids[(n + 1) % len(ids)] for n, a in enumerate(ids)}
    for r in got:
        own = -(2**63) if r.doc_id is None else r.doc_id
        wanted = set()
        for t in texts[own]:
            for nxt in texts[after[own]]:
                k = len(t) // 3
                wanted.add((len(t), sha(t[: len(t) - k] + nxt[:k])))
        assert (r.n_chars, r.edited_sha256) in wanted
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1 and r.edit_from is None


def test_equal_texts_have_equal_fingerprints_and_no_others(spark, tmp_path):
    texts = ["", "\n", "a.b", "a. b", "a.\nb", "b\na.", "a", "a\n", "x" * 5000, "a|", "|"]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    got = {r.doc_id: r.fingerprint for r in fingerprints(stored(spark, tmp_path / "d", rows)).collect()}
    for i, a in rows:
        for j, b in rows:
            assert (got[i] == got[j]) == (a == b)


def test_branches_locate_an_edit(spark):
    old = "\n".join(f"Paragraph {i}. It has text." for i in range(200))
    new = old.replace("Paragraph 120.", "Paragraph one hundred twenty.")
    row = spark.createDataFrame([(old, new)], "a string, b string")
    row = with_tree(with_tree(row, "a", "x_"), "b", "y_")
    span = edit_span("x_", "y_")
    assert tuple(row.select(span.alias("s")).first().s) == (120, 121)
    sections = row.select(
        F.size(F.array_except("x_sections", "y_sections")), F.size("x_sections")
    ).first()
    assert sections[0] == 1 and sections[1] > 3


def test_spans_are_those_of_the_paragraphs_side_by_side(spark):
    random.seed(12)
    rows = []
    for i in range(300):
        old = [random.choice(["", "a.", "b", "c. d", f"p{random.randint(0, 60)}"]) for _ in range(random.randint(1, 60))]
        new = list(old)
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, len(new))
            new[at : at + random.randint(0, 2)] = ["new", f"p{i}", ""][: random.randint(0, 3)]
        rows.append((i, "\n".join(old), "\n".join(new)))
    trees = with_tree(with_tree(spark.createDataFrame(rows, "i long, a string, b string"), "a", "x_"), "b", "y_")
    for r in trees.select("i", "a", "b", edit_span("x_", "y_").alias("s")).collect():
        old, new = r.a.split("\n"), r.b.split("\n")
        same = [x == y for x, y in zip(old, new)]
        back = [x == y for x, y in zip(old[::-1], new[::-1])]
        head = same.index(False) if False in same else len(same)
        tail = back.index(False) if False in back else len(back)
        assert (None if r.a == r.b else (head, max(head, len(old) - tail))) == (r.s and tuple(r.s))


@pytest.mark.parametrize("shifts", [(), (2, 3), (12, 18, 17)])
def test_following_ids(spark, shifts):
    ids = [0, 1, 5, 4096, 4097, 2**40, 2**62, -3, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "_id long")
    got = {r._id: r._next for r in following(df, shifts).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: down[(n + 1) % len(down)] for n, a in enumerate(down)}


def test_empty_and_single(spark, tmp_path):
    assert edit_trace(empty_docs(spark, tmp_path / "d")).collect() == []
    one = edit_trace(stored(spark, tmp_path / "o", [(7, "abcabc")])).first()
    assert one.near_next == 1 and one.edited_sha256 == sha("abcaab")

import random
import re

import pytest
from llm.odd import SCHEMA, empty_docs, odd_docs, odd_rows, stored

from storeloom.llm import phrase_index as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, tests, window=10, terms=4, within=20):
    """All windows against all documents, and every position as the end of a proximity match."""
    texts = [(i, words(t)) for i, t in tests]
    counts = {}
    own = [words(t) for _, t in docs]
    for w in own:
        for term in w:
            counts[term] = counts.get(term, 0) + 1
    out = []
    for (doc_id, _), w in zip(docs, own):
        hit, items, near = set(), set(), set()
        for item_id, t in texts:
            if not t:
                continue
            size = min(window, len(t))
            phrases = {tuple(t[s : s + size]) for s in range(len(t) - size + 1)}
            at = [p for p in range(len(w) - size + 1) if tuple(w[p : p + size]) in phrases]
            hit.update(p + k for p in at for k in range(size))
            if at and item_id is not None:
                items.add(str(item_id))
            rare = set(sorted(set(t), key=lambda x: (counts.get(x, 0), x.encode()))[:terms])
            if item_id is not None and any(
                rare <= set(w[max(0, p - within + 1) : p + 1]) for p in range(len(w))
            ):
                near.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(items), sorted(near)))
    return sorted(out, key=str)


def found(docs, tests, **k):
    return sorted((tuple(r) for r in P.contamination(docs, tests, **k).collect()), key=str)


def planted():
    """Texts with copies of test passages whole, in part, at either end, and in hot groups."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 60
    tests = [(i, " ".join(random.choices(vocabulary, k=n))) for i, n in enumerate([25, 12, 10, 9, 4, 1, 0, 40])]
    tests += [(7, " ".join(random.choices(vocabulary, k=14))), (None, "an item without id but with eleven words in it here")]
    tests += [(50, "the the the the the the the the the the the"), (51, None), (52, "!?"), (1, tests[1][1])]
    docs = []
    for i in range(150):
        w = random.choices(vocabulary, k=random.choice([0, 3, 30, 80]))
        for _ in range(random.randint(0, 2)):
            _, t = random.choice(tests)
            t = (t or "").split()
            cut = random.randint(0, 3)
            at = random.randint(0, len(w))
            w[at:at] = t[cut : len(t) - random.randint(0, 2)]
        docs.append((i, random.choice([" ", "--", ", "]).join(w).replace("w1", random.choice(["w1", "W1"]))))
    docs += [(None, tests[0][1]), (None, tests[0][1]), (None, "w1 " + tests[2][1]), (5, "?" + tests[1][1] + "!")]
    docs += [(900 + i, "see " + tests[0][1]) for i in range(300)]
    docs += [(2000, "The " * 5000), (2001, "an item without id but with eleven words in it here")]
    return docs, tests


def test_equals_all_windows(spark, tmp_path):
    docs, tests = planted()
    left = stored(spark, tmp_path / "d", docs)
    right = stored(spark, tmp_path / "b", tests, "item_id long, text string")
    assert found(left, right) == plain(docs, tests)


@pytest.mark.parametrize("window", [3, 7])
def test_other_windows(spark, tmp_path, window):
    docs, tests = planted()
    left = stored(spark, tmp_path / "d", docs)
    right = stored(spark, tmp_path / "b", tests, "item_id long, text string")
    assert found(left, right, window=window) == plain(docs, tests, window)


def test_odd_documents(spark, tmp_path):
    tests = [(1, "shared line of text"), (2, "one id"), (3, "alpha"), (4, "日本語"), (5, "délta"), (6, "DÉLTA")]
    right = stored(spark, tmp_path / "b", [(*t, "x", 1) for t in tests], "item_id long, text string, key string, pos int")
    assert found(odd_docs(spark, tmp_path / "d"), right) == plain(odd_rows(), tests)


def test_empty_tables(spark, tmp_path):
    none = stored(spark, tmp_path / "b", [], "item_id long, text string")
    assert found(empty_docs(spark, tmp_path / "d"), none) == []
    assert found(odd_docs(spark, tmp_path / "o"), none) == plain(odd_rows(), [])
    one = stored(spark, tmp_path / "c", [(1, "alpha")], "item_id long, text string")
    assert found(spark.read.schema(SCHEMA).parquet(str(tmp_path / "d")), one) == []


def test_runs_say_where(spark, tmp_path):
    tests = stored(spark, tmp_path / "b", [(1, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = stored(spark, tmp_path / "d", [(1, "x a b c d e f g h i j k y b c d e f g h i j k l")])
    runs = P.phrase_matches(P.build_index(docs, tests))
    assert sorted((r["first"], r["last"], r["offset"]) for r in runs.collect()) == [(1, 11, 0), (13, 23, 1)]

from collections import defaultdict

from llm.odd import empty_docs, odd_docs, odd_rows, stored

from storeloom.llm.line_dedup import line_dedup

SPACES = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_chars=10, min_docs=2):
    last = float("inf")
    key = lambda line: line.strip(SPACES).translate(UPPER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = last if i is None else i
        gone = lambda k: len(k) >= min_chars and len(holders[k]) >= min_docs and min(holders[k]) != own
        kept = [x for x in lines if not gone(key(x))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df, **k):
    got = line_dedup(df, **k).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_odd_documents(spark, tmp_path):
    df = odd_docs(spark, tmp_path / "d")
    assert run(df) == plain(odd_rows())
    assert run(df, min_chars=3, min_docs=4) == plain(odd_rows(), 3, 4)
    out = line_dedup(df)
    # A column called like an added one is replaced, all others stay.
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {r._doc for r in out.collect()} == {"x"}


def test_empty_table(spark, tmp_path):
    assert run(empty_docs(spark, tmp_path / "d")) == []


def test_line_of_all_documents_stays_once(spark, tmp_path):
    rows = [(i, f"Everyone has this line\nown line {i} of text") for i in range(500)]
    got = run(stored(spark, tmp_path / "d", rows))
    assert got == plain(rows)
    assert sum(r[3] for r in got) == 499

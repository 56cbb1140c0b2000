"""The stages one after the other, against plain versions of what each decides."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from compare import sf_dir
from llm.odd import empty_docs, odd_rows, stored
from llm.test_line_dedup import plain as plain_lines
from llm.test_simhash import plain as plain_groups

from storeloom.llm import bpe, quality_forest
from storeloom.llm.common import saved, table

DIR = sf_dir("0.001")


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, DIR, "documents")]
    for name, stage in cp.STAGES:
        out.append(saved(stage(spark, out[-1], DIR), f"test-{name}"))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "soft_mixing", "byte_bpe"
    ]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_quality_rejects_what_the_rules_reject(steps):
    kept = {i for i, _ in texts(steps[1])}
    for i, t in texts(steps[0]):
        if quality_forest.base_failed(quality_forest.statistics(t)[0]):
            assert i not in kept
    assert set(texts(steps[1])) <= set(texts(steps[0]))
    assert len(kept) > 0.7 * steps[0].count()


def test_lines_are_those_of_the_plain_version(steps):
    want = [(i, t) for i, t, *_ in plain_lines(texts(steps[1]))]
    assert texts(steps[2]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_document_of_each_group_stays(steps):
    before = texts(steps[2])
    firsts = {component for _, _, component in plain_groups(before)}
    assert texts(steps[3]) == [(i, t) for i, t in before if i in firsts]


def test_mixing_takes_rows_unchanged(steps):
    assert set(texts(steps[4])) <= set(texts(steps[3]))
    assert steps[4].count() > 0.5 * steps[3].count()


def test_tokens_are_those_of_the_library(steps):
    tiktoken = pytest.importorskip("tiktoken")
    from storeloom.llm.queries import vocabulary

    ranks = bpe.read_ranks(vocabulary())
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(i, library.encode_ordinary(t)) for i, t in texts(steps[4])]
    assert sorted((r.doc_id, list(r.ids)) for r in steps[5].collect()) == want


def test_run_gives_the_same(spark, steps):
    got = sorted((r.doc_id, r.ids_sha256, r.n_tokens) for r in cp.run(spark, DIR).collect())
    assert got == sorted((r.doc_id, r.ids_sha256, r.n_tokens) for r in steps[5].collect())


ODD = "doc_id long, text string, lang string, kept boolean, n_lines string, anomaly string, row int, columns string, `a.b` string, n_chars long"


def odd_table(spark, folder, rows):
    rows = [(i, t, "xx", None, "mine", "own", n, "c", f"dot {n}", -1) for n, (i, t) in enumerate(rows)]
    return stored(spark, folder, rows, ODD)


def everything(df):
    return Counter(tuple(r) for r in df.collect())


def test_odd_documents_keep_all_their_columns(spark, tmp_path):
    docs = odd_table(spark, tmp_path / "odd", odd_rows())
    at = {c: n for n, c in enumerate(docs.columns)}
    for n, (name, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        got = everything(out)
        if name == "line_dedup":
            assert len(got) == docs.count()
            plain_cut = Counter((i, t) for i, t, *_ in plain_lines(odd_rows()))
            assert Counter((r[0], r[1]) for r in got.elements()) == plain_cut
            assert all(r[at["n_chars"]] == len(r[1]) for r in got)
            rest = [c for c in docs.columns if c not in ("text", "n_chars")]
            assert everything(out.select(*[f"`{c}`" for c in rest])) == everything(
                docs.select(*[f"`{c}`" for c in rest])
            )
        else:
            assert got <= everything(docs)
    assert cp.token_stage(spark, docs, DIR).count() == docs.count()


def test_near_stage_keeps_one_row_of_each_group(spark, tmp_path):
    one, other = "a b c d e f g", "quite another text of some length"
    rows = [(1, one), (5, other), (5, one), (None, one), (None, one), (7, one), (None, "third kind of text here")]
    docs = odd_table(spark, tmp_path / "near", rows)
    got = sorted(((r.doc_id, r.text) for r in cp.near_stage(spark, docs, DIR).collect()), key=str)
    assert got == [(1, one), (5, other), (None, "third kind of text here")]


def test_empty_documents(spark, tmp_path):
    docs = empty_docs(spark, tmp_path / "empty")
    for n, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, DIR)
        assert out.collect() == []
        assert n == len(cp.STAGES) - 1 or out.columns == docs.columns

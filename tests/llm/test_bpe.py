import random

import pytest
from llm.odd import empty_docs, odd_docs, odd_rows, stored

from storeloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(df, rows, ranks, library, **k):
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    apart, together = bpe.decode(bpe.encode(df, ranks, **k), ranks), bpe.round_trip(df, ranks, **k)
    for got in (apart.collect(), together.collect()):
        found = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=str)
        assert found == sorted(want, key=str)


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == P.PATTERN


@pytest.mark.parametrize("pack_chars", [1, 500, 8_000_000])
def test_odd_documents(spark, tmp_path, ranks, library, pack_chars):
    check(odd_docs(spark, tmp_path / "d"), odd_rows(), ranks, library, pack_chars=pack_chars)


def test_empty_table(spark, tmp_path, ranks, library):
    check(empty_docs(spark, tmp_path / "d"), [], ranks, library)


def test_strange_characters(spark, tmp_path, ranks, library):
    random.seed(6)
    points = [c for c in range(0x2FFFF) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(map(chr, random.choices(points, k=200)))) for i in range(40)]
    rows += [(100, "   ​ x\r\n\t's don't '' ..."), (101, "<|endoftext|>")]
    check(stored(spark, tmp_path / "d", rows), rows, ranks, library)


def test_words_long_and_short(ranks):
    one = tiktoken.Encoding("w", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    for n in [*range(1, 120), 5000]:
        word = "".join(random.choice("aàethin日本ñ!* ") for _ in range(n))
        assert bpe.encode_word(word.encode(), ranks) == one.encode_ordinary(word)


def test_null_ids_decode_to_nothing(spark, ranks):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(rows, ranks).collect()] == [b"", b""]

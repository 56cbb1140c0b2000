"""Odd documents that every operator has to cope with, and readers that store them."""

import hashlib
import random

SCHEMA = (
    "doc_id long, text string, lang string, kept boolean, _doc string, _text string, "
    "_rest string, ids string, fingerprint int, n_lines string"
)
LONG = " ".join(f"word{i % 977} and.\nLine {i}" for i in range(30_000))


def odd_rows():
    """Nulls in all columns, empty and very long texts, ties, repeated rows."""
    random.seed(4)
    words = ["alpha", "beta", "Gamma", "délta", "*x*", "shared line of text", "\t", "日本語"]
    texts = [
        "\n".join(" ".join(random.choices(words, k=random.randint(0, 9))) for _ in range(random.randint(0, 6)))
        for _ in range(25)
    ]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(200, None), (201, ""), (None, "shared line of text\nno id"), (None, None)]
    rows += [(202, LONG), (203, LONG + "x"), (204, "same text twice"), (204, "same text twice")]
    rows += [(205, "one id\nshared line of text"), (205, "other text\nshared line of text")]
    rows += [(206, "\r\n \n\n"), (207, "\x00\x01 nul\n\x0b"), (208, "a" * 2000)]
    return rows


def stored(spark, folder, rows, schema="doc_id long, text string"):
    """The rows as a table of files, which gives the same rows whenever it is read."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def odd_docs(spark, folder):
    rows = [(i, t, None, None, "x", "y", None, "z", 5, None) for i, t in odd_rows()]
    return stored(spark, folder, rows, SCHEMA)


def empty_docs(spark, folder):
    return stored(spark, folder, [], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()

import random
from collections import Counter

from conftest import rows

from storeloom.sources.checksum_tree import (
    checksum_tree,
    differing_leaves,
    differing_rows,
    read_tree,
    write_tree,
)

SCHEMA = "id long, v string, w double"


def plain(a, b):
    """Rows compared key by key, in number and content."""
    sides = []
    for rows_ in (a, b):
        by_key = {}
        for r in rows_:
            by_key.setdefault(r[0], Counter())[r] += 1
        sides.append(by_key)
    out, (left, right) = [], sides
    for key in {*left, *right}:
        one, two = left.get(key, Counter()), right.get(key, Counter())
        if one != two:
            change = "lost" if not two else "added" if not one else "changed"
            out.append((key, change, sum(one.values()), sum(two.values())))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def items(n, seed):
    random.seed(seed)
    return [(random.choice([i, i * 1000, -i, 2**62 - i]), f"v{i % 7}", float(i)) for i in range(n)]


def test_lists_exactly_what_differs(spark):
    a = items(3000, 1) + [(None, "x", 1.0), (None, "y", None), (5, "twice", 1.0), (5, "twice", 1.0)]
    b = [r for i, r in enumerate(a) if i % 301] + [(77, "new", 0.0), (None, "x", 1.0), (-9, None, None)]
    b = [(k, "changed" if i % 499 == 7 else v, w) for i, (k, v, w) in enumerate(b)]
    got = differing_rows(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", leaf_bits=4)
    assert rows(got) == plain(a, b)


def test_equal_tables_in_any_order_and_empty_ones(spark):
    a = items(500, 2)
    df, turned = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(a[::-1], SCHEMA).repartition(7)
    assert rows(differing_rows(df, turned, "id")) == []
    none = spark.createDataFrame([], SCHEMA)
    assert rows(differing_rows(none, none, "id")) == []
    assert rows(differing_rows(df, none, "id")) == plain(a, [])


def test_only_leaves_that_differ_are_found(spark, tmp_path):
    a = [(i, "v", 0.0) for i in range(20_000)]
    b = [(i, "w" if i in (3, 9_000, 19_999) else "v", 0.0) for i in range(20_000)]
    for name, side in (("a", a), ("b", b)):
        write_tree(spark.createDataFrame(side, SCHEMA), "id", str(tmp_path / name), leaf_bits=6)
    trees = [read_tree(spark, str(tmp_path / n)) for n in "ab"]
    assert rows(differing_leaves(*trees)) == [(0,), (9_000 >> 6,), (19_999 >> 6,)]
    top = checksum_tree(spark.createDataFrame(a, SCHEMA), "id", leaf_bits=6).filter("level = 4")
    assert [(r.node, r.n) for r in top.collect()] == [(0, 20_000)]


def test_two_rows_that_swap_their_contents_are_told(spark):
    a, b = [(1, "x", 0.0), (2, "y", 0.0)], [(1, "y", 0.0), (2, "x", 0.0)]
    got = differing_rows(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id")
    assert rows(got) == [(1, "changed", 1, 1), (2, "changed", 1, 1)]

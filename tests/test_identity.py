import random

from conftest import rows
from pyspark.sql import functions as F

from storeloom.operators.identity import Personal, components, erase_everywhere


def plain_roots(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def found(spark, pairs):
    return rows(components(spark.createDataFrame(pairs, "a string, b string")))


def test_chain_hub_and_random_links(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(400)]
    random.seed(3)
    random.shuffle(chain)
    hub = [("z-hub", f"m{i}") for i in range(500)]
    loose = [(f"r{random.randint(0, 150)}", f"r{random.randint(0, 150)}") for _ in range(110)]
    pairs = chain + hub + [p for p in loose if p[0] != p[1]] + chain[:5] + [("m0", "m1")]
    assert found(spark, pairs) == plain_roots(pairs)


def test_no_links(spark):
    assert found(spark, []) == [] and found(spark, [("a", "a")]) == []


def table(spark, items):
    rows_ = spark.createDataFrame(items, "id long, doc string, phone string, name string, other string")
    phone = F.regexp_replace("phone", "[^0-9]", "")
    return Personal(rows_, {"doc": F.col("doc"), "phone": phone}, ["phone", "name"])


def test_erasure_follows_every_chain(spark):
    tables = {
        "clients": table(spark, [(1, "A", "11-1", "Ana", "x"), (2, "B", "222", "Bea", "y"), (3, None, None, "C", "z")]),
        "leads": table(spark, [(1, None, "(111)", "A?", "q"), (2, "D", "111", "Dan", "w"), (3, "B", "333", "B.", None)]),
        "queue": table(spark, [(1, "D", "444", "D.", "a"), (2, "E", "444", "E.", "b"), (3, "F", "555", "F.", "c")]),
    }
    people = spark.createDataFrame([("A",), (None,), ("nobody",), ("A",)], "doc string")
    out = erase_everywhere(tables, people, "doc", "doc")
    left = {name: [r[0] for r in rows(df.filter("name IS NOT NULL").select("id"))] for name, df in out.items()}
    assert left == {"clients": [2, 3], "leads": [3], "queue": [3]}
    assert [r[4] for r in sorted(out["queue"].collect())] == ["a", "b", "c"]
    again = erase_everywhere({n: Personal(df, tables[n].identifiers, ["phone", "name"]) for n, df in out.items()},
                             people, "doc", "doc")
    assert {n: rows(df) for n, df in again.items()} == {n: rows(df) for n, df in out.items()}


def test_one_person_with_most_rows(spark):
    many = [(i, "A" if i % 3 else f"d{i}", f"p{i % 50}" if i % 3 else f"q{i}", "n", "o") for i in range(3000)]
    out = erase_everywhere({"t": table(spark, many)}, spark.createDataFrame([("A",)], "doc string"), "doc", "doc")
    # Numbers are compared by their digits: p7 and q7 are one.
    shared = {i % 50 for i, *_ in many if i % 3}
    kept = [i for i, *_ in many if not i % 3 and i not in shared]
    assert [r[0] for r in rows(out["t"].filter("name IS NOT NULL").select("id"))] == kept

from conftest import rows
from pyspark.sql import functions as F

from storeloom.operators import keyed


def test_insert_ignore_keeps_old_first_of_batch_and_null_keys(spark):
    target = spark.createDataFrame([(1, "old")], "id INT, v STRING")
    batch = spark.createDataFrame(
        [(1, "new", 1), (2, "b", 2), (2, "a", 1), (None, "n1", 1), (None, "n2", 1)],
        "id INT, v STRING, pos INT",
    )
    once = keyed.insert_ignore(target, batch, ["id"], ["pos"])
    assert rows(once) == [(1, "old"), (2, "a"), (None, "n1"), (None, "n2")]
    again = keyed.insert_ignore(once.dropna(), batch.dropna(), ["id"], ["pos"])
    assert rows(again) == [(1, "old"), (2, "a")]


def test_insert_ignore_on_a_composite_key(spark):
    target = spark.createDataFrame([(1, "x", 0)], "a INT, b STRING, v INT")
    batch = spark.createDataFrame([(1, "x", 9), (1, "y", 1)], "a INT, b STRING, v INT")
    assert rows(keyed.insert_ignore(target, batch, ["a", "b"], ["v"])) == [(1, "x", 0), (1, "y", 1)]


def test_upsert_latest_edits_deletes_and_recreates(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id INT, v STRING")
    changes = spark.createDataFrame(
        [
            (1, "a1", "edit", 1),
            (1, "a2", "edit", 2),
            (2, None, "delete", 1),
            (3, None, "delete", 1),
            (3, "c2", "create", 2),
            (4, "d", None, 1),
            (5, "e", "create", 1),
            (5, None, "delete", 2),
        ],
        "id INT, v STRING, op STRING, ts INT",
    )
    once = keyed.upsert_latest(target, changes, ["id"], ["ts"])
    assert rows(once) == [(1, "a2"), (3, "c2"), (4, "d")]
    assert rows(keyed.upsert_latest(once, changes, ["id"], ["ts"])) == rows(once)


def test_upsert_latest_twice_with_null_keys(spark):
    target = spark.createDataFrame([(None, 1, "a"), (2, None, "b")], "x INT, y INT, v STRING")
    changes = spark.createDataFrame(
        [(None, 1, "a2", "edit", 1), (None, None, "n", "create", 1), (2, None, None, "delete", 2)],
        "x INT, y INT, v STRING, op STRING, ts INT",
    )
    once = keyed.upsert_latest(target, changes, ["x", "y"], ["ts"])
    assert rows(once) == [(None, None, "n"), (None, 1, "a2")]
    assert rows(keyed.upsert_latest(once, changes, ["x", "y"], ["ts"])) == rows(once)


def test_upsert_latest_breaks_ties_by_the_next_order_column(spark):
    target = spark.createDataFrame([], "id INT, v STRING")
    changes = spark.createDataFrame(
        [(1, "x", "edit", 5, 1), (1, "y", "edit", 5, 2)], "id INT, v STRING, op STRING, ts INT, n INT"
    )
    assert rows(keyed.upsert_latest(target, changes, ["id"], ["ts", "n"])) == [(1, "y")]


def test_partial_upsert_takes_last_value_per_column(spark):
    target = spark.createDataFrame([(1, 10, 5), (2, 20, 6)], "id INT, price INT, stock INT")
    patches = spark.createDataFrame(
        [(1, 11, None, 1), (1, None, 4, 2), (1, 12, None, 3), (9, 1, 1, 1)],
        "id INT, price INT, stock INT, ts INT",
    )
    out = keyed.partial_upsert(target, patches, ["id"], ["price", "stock"], ["ts"])
    assert rows(out) == [(1, 12, 4), (2, 20, 6)]


def test_fill_defaults(spark):
    df = spark.createDataFrame([(None, "x"), (3, None)], "n INT, s STRING")
    out = keyed.fill_defaults(df, {"n": F.lit(0), "s": F.lit("Frio")})
    assert rows(out) == [(0, "x"), (3, "Frio")]


def test_constraint_audit_counts_each_kind(spark):
    df = spark.createDataFrame(
        [(1, "a", "123", 5), (1, None, "12", -1), (2, "abcd", "1234", 7), (None, "a", None, None)],
        "id INT, name STRING, doc STRING, parent INT",
    )
    parents = spark.createDataFrame([(5,)], "key INT")
    report = keyed.constraint_audit(
        df,
        [
            keyed.not_null("name"),
            keyed.max_length("name", 3),
            keyed.fixed_length("doc", [2, 3]),
            keyed.non_negative("parent"),
        ],
        unique=["id"],
        parents={"parent": (parents, "key")},
    )
    assert {(r.rule, r.column_name): r.violations for r in report.collect()} == {
        ("not_null", "name"): 1,
        ("max_length", "name"): 1,
        ("fixed_length", "doc"): 1,
        ("non_negative", "parent"): 1,
        ("unique", "id"): 1,
        ("foreign_key", "parent"): 2,
    }


def test_constraint_audit_of_nothing_reports_zero(spark):
    df = spark.createDataFrame([], "id INT, name STRING")
    report = keyed.constraint_audit(
        df, [keyed.not_null("name")], unique=["id"], parents={"id": (df, "id")}
    )
    assert [r.violations for r in report.collect()] == [0, 0, 0]

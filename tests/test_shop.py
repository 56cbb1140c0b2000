from datetime import datetime
from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from storeloom.operators import crm, stock

T0 = datetime(2024, 1, 1)


def test_customer_360_keeps_customers_without_orders(spark):
    customers = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING")
    orders = spark.createDataFrame(
        [(1, Decimal("2.50"), T0, "P"), (1, Decimal("1.00"), datetime(2024, 2, 1), "F")],
        "id INT, total DECIMAL(10,2), ts TIMESTAMP_NTZ, status STRING",
    )
    got = rows(crm.customer_360(customers, orders, "id", "total", "ts", "status", ["P", "F"]))
    assert got == [
        (1, "a", 2, Decimal("3.50"), T0, datetime(2024, 2, 1), 1, 1),
        (2, "b", 0, Decimal("0.00"), None, None, 0, 0),
    ]


def test_orders_by_status_can_be_limited(spark):
    orders = spark.createDataFrame([("P", 1), ("F", 2), ("P", 3)], "status STRING, total INT")
    assert rows(crm.orders_by_status(orders, "status", "total", ["P"])) == [("P", 2, 4)]


def test_transitions_cross_buckets_and_keep_null_statuses(spark):
    df = spark.createDataFrame(
        [
            (1, "view", 1, 1),
            (1, "buy", 2, 1),
            (1, None, 2, 2),
            (1, "view", 30, 1),
            (2, "view", 5, 1),
            (None, "view", 5, 1),
            (None, "buy", 6, 1),
        ],
        "k INT, status STRING, ts INT, id INT",
    )
    for width in (1, 10, 1000):
        for hot_rows in (0, 2, 10**6):
            bucket = F.floor(F.col("ts") / width)
            got = crm.transitions(df, "k", "status", ["ts", "id"], bucket, hot_rows)
            assert rows(got) == [("buy", None, 1), ("view", "buy", 1), (None, "view", 1)], width


def test_pending_recovery_needs_contact_and_no_later_payment(spark):
    pending = spark.createDataFrame(
        [(1, 7, T0), (2, 7, datetime(2024, 3, 1)), (3, 8, T0), (4, 9, T0), (5, 7, datetime(2024, 2, 1))],
        "id INT, cust INT, ts TIMESTAMP_NTZ",
    )
    customers = spark.createDataFrame([(7, "x"), (8, None), (9, "y")], "cust INT, contact STRING")
    paid = spark.createDataFrame(
        [(7, datetime(2023, 1, 1)), (7, datetime(2024, 2, 1))], "cust INT, paid TIMESTAMP_NTZ"
    )
    got = crm.pending_recovery(pending, customers, paid, "cust", "ts", "paid", "contact")
    # Order 5 was placed at the very moment of the last payment: not a later one.
    assert {r.id for r in got.collect()} == {2, 4, 5}


def test_shipping_notices(spark):
    invoiced = spark.createDataFrame(
        [(1, 7, "T1"), (2, 7, None), (3, 8, "T3"), (4, 7, "T4")], "id INT, cust INT, code STRING"
    )
    customers = spark.createDataFrame([(7, "x"), (8, None)], "cust INT, contact STRING")
    sent = spark.createDataFrame([(4,)], "id INT")
    got = crm.shipping_notices(invoiced, customers, sent, "id", "cust", "code", "contact")
    assert {r.id for r in got.collect()} == {1}


def test_links_and_lead_conversion(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "doc INT")
    right = spark.createDataFrame([(1, "a")], "doc INT, name STRING")
    assert rows(crm.link_contacts(left, right, "doc")) == [
        (1, "a", True),
        (2, None, False),
        (None, None, False),
    ]
    assert rows(crm.unlinked(left, right, "doc")) == [(2,), (None,)]
    twice = right.unionByName(right)
    assert rows(crm.lead_conversion(left, twice, "doc")) == [(1, True), (2, False), (None, False)]
    assert rows(crm.converted_leads(left, twice, "doc")) == [(1,)]
    assert rows(crm.open_leads(left, twice, "doc")) == [(2,), (None,)]


def test_funnel_reports_empty_stages_in_order(spark):
    leads = spark.createDataFrame([("Frio", "maps"), ("Convertido", "maps")], "s STRING, o STRING")
    got = crm.funnel(leads, "s", "o").collect()
    assert [(r.stage, r.n, r.share) for r in got] == [
        ("Frio", 1, 0.5),
        ("Morno", 0, 0.0),
        ("Quente", 0, 0.0),
        ("Convertido", 1, 0.5),
    ]


def test_normalize_contacts(spark):
    df = spark.createDataFrame(
        [
            ("+55 (21) 99999-8888", "123.456.789-09"),
            ("--", "12.345.678/0001-95"),
            (None, "12"),
            ("1", None),
        ],
        "phone STRING, doc STRING",
    )
    assert [tuple(r) for r in crm.normalize_contacts(df, "phone", "doc").collect()] == [
        ("5521999998888", "12345678909", "CPF"),
        (None, "12345678000195", "CNPJ"),
        (None, "12", "invalid"),
        ("1", None, None),
    ]


def test_the_three_seed_supplies_raise_the_alert(spark):
    # On hand and minimum of the supplies the shop starts with.
    seed = spark.createDataFrame([("box", 5, 25), ("tape", 2, 10), ("label", 150, 500)], "i STRING, q INT, m INT")
    assert {r.i: r.deficit for r in stock.low_stock(seed, "q", "m").collect()} == {
        "box": 20,
        "tape": 8,
        "label": 350,
    }
    exact = spark.createDataFrame([("x", 10, 10), ("y", None, 10)], "i STRING, q INT, m INT")
    assert stock.low_stock(exact, "q", "m").isEmpty()


def test_purchase_report_pages_hold_all_items_in_order(spark):
    low = spark.range(500).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("s"),
        F.col("id").alias("item"),
        (F.col("id") % 3 + 1).alias("deficit"),
    )
    pages = stock.purchase_report(low, "s", "item", F.floor(F.col("item") / 40), 30, hot_rows=100)
    hot = sorted((r for r in pages.collect() if r.s == "hot"), key=lambda r: r.page)
    assert [len(r["items"]) for r in hot] == [30] * 8 + [10]
    assert [i.item for r in hot for i in r["items"]] == list(range(0, 500, 2))
    assert {r.n_items for r in hot} == {250}
    assert {r.to_buy for r in hot} == {sum(i % 3 + 1 for i in range(0, 500, 2))}


def test_weekly_position_cuts_on_local_mondays(spark):
    moves = spark.createDataFrame(
        [
            (1, datetime(2024, 1, 8, 10, 59), 5),
            (1, datetime(2024, 1, 8, 11, 0), -2),
            (1, datetime(2024, 1, 20), -1),
            (2, datetime(2024, 1, 9), 7),
        ],
        "item INT, ts TIMESTAMP_NTZ, q INT",
    )
    # 11:00 UTC is 08:00 in São Paulo.
    got = rows(stock.weekly_position(moves, "item", "ts", "q", "America/Sao_Paulo"))
    cut = datetime(2024, 1, 8, 8)
    week = [datetime(2024, 1, 1, 8), cut, datetime(2024, 1, 15, 8), datetime(2024, 1, 22, 8)]
    assert got == [
        (1, week[0], 5, week[1], 5),
        (1, week[1], -2, week[2], 3),
        (1, week[2], -1, week[3], 2),
        (2, week[1], 7, week[2], 7),
    ]


def test_apply_scans_flags(spark):
    catalog = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "sku STRING, n INT")
    scans = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "sku STRING")
    assert rows(stock.apply_scans(catalog, scans, "sku", "n")) == [
        ("a", 2, 1, 1, False, False),
        ("b", 1, 2, -1, False, True),
        ("c", 0, 0, 0, False, False),
        ("zz", None, 1, None, True, False),
    ]

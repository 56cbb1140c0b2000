"""Orders, customers, leads and stock on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.functions.clock import minutes
from storeloom.operators import crm, stock
from storeloom.plans.fixtures import contact, some_without, table, with_strangers
from storeloom.plans.registry import query


@query(
    "customer_360",
    """
    WITH o AS (
        SELECT o_custkey, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(10,2))) AS spend,
               min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
               count(*) FILTER (o_orderstatus = 'P') AS n_P,
               count(*) FILTER (o_orderstatus = 'F') AS n_F,
               count(*) FILTER (o_orderstatus = 'O') AS n_O
        FROM orders GROUP BY o_custkey
    ), customers AS (
        SELECT c_custkey, c_name FROM customer
        UNION ALL SELECT -c_custkey - 1, c_name FROM customer
    )
    SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders,
           CAST(coalesce(spend, 0) AS DECIMAL(18,2)) AS spend, first_order, last_order,
           coalesce(n_P, 0) AS n_P, coalesce(n_F, 0) AS n_F, coalesce(n_O, 0) AS n_O
    FROM customers LEFT JOIN o ON o_custkey = c_custkey
    """,
)
def customer_360(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = with_strangers(table(spark, sf_dir, "customer"), "c_custkey").select(
        "c_custkey", "c_name"
    )
    view = crm.customer_360(
        customers, orders, "c_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", "PFO"
    )
    return view.withColumn("spend", F.col("spend").cast("decimal(18,2)"))


@query(
    "orders_by_status",
    """
    SELECT o_orderstatus, count(*) AS n_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(10,2))) AS DECIMAL(18,2)) AS total
    FROM orders GROUP BY o_orderstatus
    """,
)
def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crm.orders_by_status(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    return out.withColumn("total", F.col("total").cast("decimal(18,2)"))


@query(
    "status_transitions",
    """
    SELECT previous, current, count(*) AS n FROM (
        SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
               event_type AS current
        FROM events)
    WHERE previous IS NOT NULL GROUP BY previous, current
    """,
)
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # A minute of the busiest user is still a small task.
    return crm.transitions(
        events, "user_id", "event_type", ["ts", "event_id"], minutes(events, "ts")
    )


@query(
    "status_transitions_hot",
    """
    SELECT previous, current, count(*) AS n FROM (
        SELECT lag(event_type) OVER (PARTITION BY user_id
                   ORDER BY ts NULLS FIRST, event_id) AS previous, event_type AS current
        FROM (SELECT * REPLACE (CASE WHEN event_id % 10 > 0 THEN ts END AS ts) FROM events))
    WHERE previous IS NOT NULL GROUP BY previous, current
    """,
)
def status_transitions_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user cut into buckets, some events without a time."""
    events = some_without(table(spark, sf_dir, "events"), "ts", "event_id")
    return crm.transitions(
        events, "user_id", "event_type", ["ts", "event_id"], minutes(events, "ts"), hot_rows=1
    )


@query(
    "pending_recovery",
    """
    SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(10,2)) AS o_totalprice,
           o_orderdate, c_name AS contact
    FROM orders p JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0
    WHERE o_orderstatus = 'P' AND NOT EXISTS (
        SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = p.o_custkey
                                 AND f.o_orderdate > p.o_orderdate)
    """,
)
def pending_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").drop("o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), contact()
    )
    paid = orders.filter(F.col("o_orderstatus") == "F").select(
        "o_custkey", F.col("o_orderdate").alias("paid_at")
    )
    pending = orders.filter(F.col("o_orderstatus") == "P").drop("o_orderstatus")
    return crm.pending_recovery(
        pending, customers, paid, "o_custkey", "o_orderdate", "paid_at", "contact"
    )


@query(
    "shipping_notices",
    """
    SELECT o_orderkey, o_custkey, 'TRK' || CAST(o_orderkey AS VARCHAR) AS tracking,
           c_name AS contact
    FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0
    WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS DECIMAL(10,2)) >= 50000
      AND o_orderpriority <> '1-URGENT'
    """,
)
def shipping_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    # Small orders travel without tracking; urgent ones were announced already.
    code = F.when(F.col("o_totalprice") >= 50000, F.concat(F.lit("TRK"), "o_orderkey"))
    invoiced = orders.filter(F.col("o_orderstatus") == "F").select(
        "o_orderkey", "o_custkey", code.alias("tracking")
    )
    sent = orders.filter(F.col("o_orderpriority") == "1-URGENT")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), contact()
    )
    return crm.shipping_notices(
        invoiced, customers, sent, "o_orderkey", "o_custkey", "tracking", "contact"
    )


@query(
    "contact_link",
    """
    SELECT contact_id, turns, c_name, c_name IS NOT NULL AS linked
    FROM (SELECT conv_id * 20 AS contact_id, count(*) AS turns FROM conversations GROUP BY 1)
    LEFT JOIN customer ON c_custkey = contact_id
    """,
)
def contact_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = (
        table(spark, sf_dir, "conversations")
        .groupBy((F.col("conv_id") * 20).alias("contact_id"))
        .agg(F.count(F.lit(1)).alias("turns"))
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("contact_id"), "c_name"
    )
    return crm.link_contacts(conversations, customers, "contact_id")


@query(
    "lead_funnel",
    """
    WITH leads AS (
        SELECT c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Frio'
            WHEN 'FURNITURE' THEN 'Quente' WHEN 'MACHINERY' THEN 'other'
            ELSE 'Convertido' END AS stage
        FROM customer
    ), stages(position, stage) AS (
        VALUES (0, 'Frio'), (1, 'Morno'), (2, 'Quente'), (3, 'Convertido'), (4, 'other')
    ), origins AS (SELECT c_nationkey, count(*) AS n_all FROM leads GROUP BY 1)
    SELECT o.c_nationkey, s.position, s.stage, count(l.stage) AS n,
           round(count(l.stage) / any_value(n_all), 6) AS share
    FROM origins o CROSS JOIN stages s
    LEFT JOIN leads l ON l.c_nationkey = o.c_nationkey AND l.stage = s.stage
    GROUP BY o.c_nationkey, s.position, s.stage
    HAVING s.position < 4 OR count(l.stage) > 0
    """,
)
def lead_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    stage = (
        F.when(segment == "BUILDING", "Frio")
        .when(segment == "FURNITURE", "Quente")
        .when(segment == "MACHINERY", "lost")
        .otherwise("Convertido")
    )
    leads = table(spark, sf_dir, "customer").select("c_nationkey", stage.alias("stage"))
    return crm.funnel(leads, "stage", "c_nationkey")


DOCUMENT = """CASE WHEN c_mktsegment = 'FURNITURE' THEN '12.345'
    WHEN c_nationkey < 12 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '-09'
    ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '/0001-09' END"""


@query(
    "contact_normalize",
    f"""
    SELECT c_custkey, '5521' || regexp_replace(c_name, '[^0-9]', '', 'g') AS phone,
           regexp_replace(doc, '[^0-9]', '', 'g') AS document,
           CASE length(regexp_replace(doc, '[^0-9]', '', 'g'))
               WHEN 11 THEN 'CPF' WHEN 14 THEN 'CNPJ' ELSE 'invalid' END AS document_class
    FROM (SELECT *, {DOCUMENT} AS doc FROM customer)
    """,
)
def contact_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("+55 (21) "), "c_name").alias("phone"),
        F.expr(DOCUMENT.replace("VARCHAR", "STRING")).alias("document"),
    )
    return crm.normalize_contacts(customers, "phone", "document")


@query(
    "lead_conversion",
    """
    SELECT c_custkey AS document, c_mktsegment,
           c_custkey IN (SELECT o_custkey FROM orders) AS converted
    FROM (SELECT c_custkey, c_mktsegment FROM customer
          UNION ALL SELECT -c_custkey - 1, c_mktsegment FROM customer)
    """,
)
def lead_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = with_strangers(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("c_custkey").alias("document"), "c_mktsegment"
    )
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"))
    return crm.lead_conversion(leads, buyers, "document")


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").alias("on_hand"), F.lit(10).alias("minimum")
    )


@query(
    "low_stock",
    """
    SELECT p_partkey, p_size AS on_hand, 10 AS minimum, 10 - p_size AS deficit
    FROM part WHERE p_size < 10
    """,
)
def low_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.low_stock(_supplies(spark, sf_dir), "on_hand", "minimum")


@query(
    "supplier_purchase_report",
    """
    WITH low AS (
        SELECT supplier, p_partkey, 10 - p_size AS deficit,
               row_number() OVER (PARTITION BY supplier ORDER BY p_partkey) AS place
        FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1)
          ON l_partkey = p_partkey
        WHERE p_size < 10
    ), totals AS (
        SELECT supplier, count(*) AS n_items, CAST(sum(deficit) AS BIGINT) AS to_buy
        FROM low GROUP BY 1
    )
    SELECT supplier, CAST((place - 1) // 10 AS BIGINT) AS page,
           string_agg(p_partkey || ':' || deficit, ',' ORDER BY p_partkey) AS items,
           any_value(n_items) AS n_items, any_value(to_buy) AS to_buy
    FROM low JOIN totals USING (supplier) GROUP BY 1, 2
    """,
)
def supplier_purchase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = stock.low_stock(_supplies(spark, sf_dir), "on_hand", "minimum")
    suppliers = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.min("l_suppkey").alias("supplier"))
    )
    bucket = F.floor(F.col("p_partkey") / 1000)
    report = stock.purchase_report(
        low.join(suppliers, "p_partkey"), "supplier", "p_partkey", bucket, page_size=10
    )
    shown = F.transform("items", lambda i: F.concat_ws(":", i["p_partkey"], i["deficit"]))
    return report.withColumn("items", F.array_join(shown, ","))


@query(
    "weekly_stock_position",
    """
    WITH weekly AS (
        SELECT l_partkey, date_trunc('week', l_shipdate - INTERVAL 8 HOUR) + INTERVAL 8 HOUR
                   AS week_start, CAST(-sum(l_quantity) AS BIGINT) AS moved
        FROM lineitem GROUP BY 1, 2
    ), last AS (
        SELECT max(date_trunc('week', o_orderdate - INTERVAL 8 HOUR) + INTERVAL 8 HOUR) AS until
        FROM orders
    ), weeks AS (
        SELECT l_partkey, unnest(generate_series(min(week_start),
                   greatest(max(week_start), any_value(until)), INTERVAL 7 DAY)) AS week_start
        FROM weekly, last GROUP BY l_partkey
    )
    SELECT l_partkey, week_start, coalesce(moved, 0) AS moved,
           week_start + INTERVAL 7 DAY AS cut_at,
           CAST(sum(moved) OVER (PARTITION BY l_partkey ORDER BY week_start) AS BIGINT) AS position
    FROM weeks LEFT JOIN weekly USING (l_partkey, week_start)
    """,
)
def weekly_stock_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", (-F.col("l_quantity")).cast("bigint").alias("quantity")
    )
    # The stock is looked at until the week of the last order, also of parts that rest.
    until = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    return stock.weekly_position(moves, "l_partkey", "l_shipdate", "quantity", until=until)


@query(
    "apply_scans",
    """
    WITH scans AS (
        SELECT l_partkey, count(*) AS scanned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
    ), catalog AS (
        SELECT CASE WHEN p_type = 'PROMO' THEN -p_partkey - 1 ELSE p_partkey END AS p_partkey,
               p_size * 20 AS on_hand
        FROM part
    )
    SELECT coalesce(p_partkey, l_partkey) AS sku, on_hand, coalesce(scanned, 0) AS scanned,
           on_hand - coalesce(scanned, 0) AS remaining, p_partkey IS NULL AS unknown_sku,
           coalesce(on_hand - coalesce(scanned, 0) < 0, false) AS oversold
    FROM catalog FULL JOIN scans ON l_partkey = p_partkey
    """,
)
def apply_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Parts on promotion go by another number here, so some scans find no part.
    sku = F.when(F.col("p_type") == "PROMO", -F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))
    catalog = table(spark, sf_dir, "part").select(
        sku.alias("sku"), (F.col("p_size") * 20).alias("on_hand")
    )
    scans = (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(F.col("l_partkey").alias("sku"))
    )
    return stock.apply_scans(catalog, scans, "sku", "on_hand")

"""Scans, payloads, webhooks and snapshots on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.plans.fixtures import ntz, table
from storeloom.plans.registry import query
from storeloom.session import work_folder
from storeloom.sources.checksum_tree import differing_rows, read_tree, write_tree
from storeloom.sources.payloads import explode_list, payload_fields
from storeloom.sources.snapshots import (
    latest_snapshot,
    log_snapshots,
    read_snapshot,
    retention,
    verify_snapshot,
    write_snapshot,
)
from storeloom.sources.webhooks import typed, webhook_stream
from storeloom.streaming.streams import run_available


@query(
    "scan_tables",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CAST(o_totalprice AS DECIMAL(10,2)) AS o_totalprice, o_orderdate
    FROM orders
    """,
)
def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").drop("o_orderpriority")


@query(
    "webhook_ingest",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS event_id,
           CASE o_orderstatus WHEN 'P' THEN 'pedido.criado' WHEN 'F' THEN 'pedido.editado'
               ELSE 'produto.editado' END AS topic,
           o_orderdate AS ts, o_custkey AS customer,
           CAST(o_totalprice AS DECIMAL(10,2)) AS total
    FROM orders
    """,
)
def webhook_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    topic = (
        F.when(F.col("o_orderstatus") == "P", "pedido.criado")
        .when(F.col("o_orderstatus") == "F", "pedido.editado")
        .otherwise("produto.editado")
    )
    drop = work_folder(spark, "webhooks")
    orders.select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        topic.alias("topic"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.to_json(
            F.struct(F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total"))
        ).alias("body"),
    ).write.json(drop)
    deliveries = webhook_stream(spark, drop)
    topics = ("pedido.criado", "pedido.editado", "produto.editado")
    stream = reduce(
        DataFrame.unionByName,
        [typed(deliveries, t, "customer BIGINT, total DECIMAL(10,2)") for t in topics],
    )
    return run_available(spark, stream, "webhook_ingest").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


@query(
    "explode_payload",
    """
    SELECT p_partkey, CAST(0 AS INTEGER) AS pos, p_brand AS id, CAST(p_size AS BIGINT) AS created
    FROM part
    UNION ALL
    SELECT p_partkey, CAST(1 AS INTEGER), p_type, CAST(p_size * 2 AS BIGINT) FROM part
    """,
)
def explode_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    def item(name: str, size):
        return F.struct(F.col(name).alias("id"), size.alias("created"))

    size = F.col("p_size")
    doc = F.to_json(F.struct(F.array(item("p_brand", size), item("p_type", size * 2)).alias("data")))
    docs = table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc"))
    return explode_list(docs, "doc", "data", "id STRING, created BIGINT")


@query(
    "raw_payload_fields",
    """
    SELECT event_id,
           CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
           CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k_text,
           CAST(NULL AS VARCHAR) AS missing
    FROM events
    """,
)
def raw_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The payload of error events is cut short, as a broken delivery would be.
    broken = F.expr("substr(props, 1, length(props) - 1)")
    payload = F.when(F.col("event_type") == "error", broken).otherwise(F.col("props"))
    events = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    fields = {"k": ("$.k", "bigint"), "k_text": ("$.k", "string"), "missing": ("$.m", "string")}
    return payload_fields(events, "payload", fields).drop("payload")


SNAPSHOT_TABLES = ("customer", "orders", "part", "events")
SNAPSHOT_DATE = "2024-01-31"


def _snapshot(spark: SparkSession, sf_dir: str, label: str):
    source = {name: table(spark, sf_dir, name) for name in SNAPSHOT_TABLES}
    root = work_folder(spark, label)
    write_snapshot(source, root, SNAPSHOT_DATE)
    return source, {n: read_snapshot(spark, root, n, SNAPSHOT_DATE) for n in source}


@query(
    "snapshot_write",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CAST(o_totalprice AS DECIMAL(10,2)) AS o_totalprice, o_orderdate, o_orderpriority,
           DATE '2024-01-31' AS snapshot_date
    FROM orders
    """,
)
def snapshot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "snapshot_write")
    write_snapshot({"orders": table(spark, sf_dir, "orders")}, root, SNAPSHOT_DATE)
    return spark.read.parquet(f"{root}/orders")


@query(
    "snapshot_verify",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_source, count(*) AS n_snapshot, "
        f"true AS matches FROM {name}"
        for name in SNAPSHOT_TABLES
    ),
)
def snapshot_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_snapshot(*_snapshot(spark, sf_dir, "snapshot_verify"))


# What goes wrong with a copy of the orders in the next two queries.
LOST, CHANGED, ADDED = "o_orderkey % 997 = 3", "o_orderkey % 1009 = 5", "o_orderkey % 1013 = 7"


def _damaged_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders, and a copy that was written with some lost, changed and added."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.expr(CHANGED), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter(f"NOT ({LOST})").withColumn("o_totalprice", price.cast(orders.schema["o_totalprice"].dataType))
    more = orders.filter(ADDED).withColumn("o_orderkey", -F.col("o_orderkey"))
    root = work_folder(spark, "snapshot_damaged")
    write_snapshot({"orders": kept.unionByName(more)}, root, "2024-01-30")
    return orders, read_snapshot(spark, root, "orders", "2024-01-30")


@query(
    "snapshot_diff",
    f"""
    SELECT o_orderkey AS key, 'lost' AS change, 1 AS n_source, 0 AS n_copy FROM orders WHERE {LOST}
    UNION ALL SELECT o_orderkey, 'changed', 1, 1 FROM orders WHERE {CHANGED} AND NOT ({LOST})
    UNION ALL SELECT -o_orderkey, 'added', 0, 1 FROM orders WHERE {ADDED}
    """,
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders a copy lost, changed or added, by descending both checksum trees."""
    orders, copy = _damaged_orders(spark, sf_dir)
    root, trees = work_folder(spark, "snapshot_trees"), []
    for name, side in (("orders", orders), ("copy", copy)):
        write_tree(side, "o_orderkey", f"{root}/{name}", leaf_bits=6)
        trees.append(read_tree(spark, f"{root}/{name}"))
    return differing_rows(orders, copy, "o_orderkey", tuple(trees), leaf_bits=6)


@query(
    "snapshot_verify_damaged",
    f"""
    SELECT 'orders' AS table_name, count(*) AS n_source,
           count(*) FILTER (NOT ({LOST})) + count(*) FILTER ({ADDED}) AS n_snapshot,
           count(*) FILTER ({LOST} OR {CHANGED} OR {ADDED}) = 0 AS matches FROM orders
    """,
)
def snapshot_verify_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, copy = _damaged_orders(spark, sf_dir)
    return verify_snapshot({"orders": orders}, {"orders": copy})


@query(
    "snapshot_latest",
    """
    SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS snapshot_date
    FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)
    """,
)
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "snapshot_latest")
    events = table(spark, sf_dir, "events").withColumn("snapshot_date", F.to_date("ts"))
    # Rebalancing gathers a day's rows into few files, and splits a day that is too big.
    events.hint("rebalance", "snapshot_date").write.partitionBy("snapshot_date").parquet(
        f"{root}/events"
    )
    days = events.select(F.lit("events").alias("table_name"), "snapshot_date").distinct()
    log_snapshots(days, root)
    return latest_snapshot(spark, root, "events")


@query(
    "snapshot_retention",
    """
    SELECT d AS snapshot_date, CAST(DATE '2024-01-30' - d AS INTEGER) AS age_days,
           (DATE '2024-01-30' - d) > 7 AS drop_it
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
    """,
)
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("snapshot_date")).distinct()
    return retention(days, "snapshot_date", ntz("2024-01-30 00:00:00"))

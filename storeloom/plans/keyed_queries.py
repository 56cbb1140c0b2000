"""Keyed writes, data quality and deduplication on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.operators import keyed
from storeloom.operators.dedup import dedup_hash, dedup_ttl, first_by_key
from storeloom.plans.fixtures import some_without, table
from storeloom.plans.registry import query


@query(
    "insert_ignore",
    """
    WITH target AS (
        SELECT c_custkey * 2 AS id, c_mktsegment AS note FROM customer
    ), batch AS (
        SELECT o_custkey AS id, o_orderpriority AS note,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
        FROM orders
    )
    SELECT id, note FROM target
    UNION ALL
    SELECT id, note FROM batch WHERE rn = 1 AND id NOT IN (SELECT id FROM target)
    """,
)
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Customers under even numbers, so that those of the batch with odd ones are new.
    target = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).alias("id"), F.col("c_mktsegment").alias("note")
    )
    batch = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderpriority").alias("note"),
        "o_orderdate",
        "o_orderkey",
    )
    return keyed.insert_ignore(target, batch, ["id"], ["o_orderdate", "o_orderkey"])


@query(
    "upsert_latest",
    """
    WITH target AS (
        SELECT c_custkey AS user_id, 'signup' AS event_type, CAST(c_acctbal AS DOUBLE) AS value
        FROM customer
    ), last AS (
        SELECT user_id, event_type, value,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)
                   AS rn
        FROM events
    )
    SELECT t.user_id, t.event_type, t.value FROM target t
    WHERE NOT EXISTS (SELECT 1 FROM last l
                      WHERE l.user_id = t.user_id AND l.event_type = t.event_type)
    UNION ALL
    SELECT user_id, event_type, value FROM last WHERE rn = 1 AND value >= 10
    """,
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.lit("signup").alias("event_type"),
        F.col("c_acctbal").cast("double").alias("value"),
    )
    changes = (
        table(spark, sf_dir, "events")
        .select("user_id", "event_type", "value", "ts", "event_id")
        .withColumn("op", F.when(F.col("value") < 10, "delete").otherwise("edit"))
    )
    return keyed.upsert_latest(target, changes, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "partial_upsert",
    """
    WITH p AS (
        SELECT o_custkey AS id, o_orderdate, o_orderkey,
               CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(10,2)) END AS price,
               CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
                    THEN o_orderkey END AS stock
        FROM orders
    ), price AS (
        SELECT id, price, row_number() OVER (PARTITION BY id
            ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM p WHERE price IS NOT NULL
    ), stock AS (
        SELECT id, stock, row_number() OVER (PARTITION BY id
            ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM p WHERE stock IS NOT NULL
    )
    SELECT c_custkey AS id, coalesce(price.price, CAST(c_acctbal AS DECIMAL(10,2))) AS price,
           coalesce(stock.stock, c_nationkey) AS stock
    FROM customer
    LEFT JOIN price ON price.id = c_custkey AND price.rn = 1
    LEFT JOIN stock ON stock.id = c_custkey AND stock.rn = 1
    """,
)
def partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("price"),
        F.col("c_nationkey").cast("bigint").alias("stock"),
    )
    status = F.col("o_orderstatus")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    patches = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.when(status == "P", F.col("o_totalprice")).alias("price"),
        F.when((status == "O") & urgent, F.col("o_orderkey")).alias("stock"),
        "o_orderdate",
        "o_orderkey",
    )
    return keyed.partial_upsert(
        target, patches, ["id"], ["price", "stock"], ["o_orderdate", "o_orderkey"]
    )


@query(
    "constraint_audit",
    """
    SELECT 'not_null' AS rule, 'c_name' AS column_name,
           count(*) FILTER (c_name IS NULL) AS violations FROM customer
    UNION ALL SELECT 'max_length', 'c_name', count(*) FILTER (length(c_name) > 17) FROM customer
    UNION ALL SELECT 'fixed_length', 'c_mktsegment',
           count(*) FILTER (length(c_mktsegment) NOT IN (8, 9)) FROM customer
    UNION ALL SELECT 'non_negative', 'c_acctbal', count(*) FILTER (c_acctbal < 0) FROM customer
    UNION ALL SELECT 'unique', 'c_custkey', count(c_custkey) - count(DISTINCT c_custkey)
           FROM customer
    UNION ALL SELECT 'unique', 'c_nationkey', count(c_nationkey) - count(DISTINCT c_nationkey)
           FROM customer
    UNION ALL SELECT 'foreign_key', 'c_nationkey', count(*) FROM customer
           WHERE c_nationkey NOT IN (SELECT n_nationkey + 1 FROM nation)
    """,
)
def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        keyed.not_null("c_name"),
        keyed.max_length("c_name", 17),
        keyed.fixed_length("c_mktsegment", [8, 9]),
        keyed.non_negative("c_acctbal"),
    ]
    # With the parents' keys one off, the foreign key has orphans to find.
    nations = table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 1)
    return keyed.constraint_audit(
        table(spark, sf_dir, "customer"),
        rules,
        unique=["c_custkey", "c_nationkey"],
        parents={"c_nationkey": (nations, "n_nationkey")},
    )


@query(
    "fill_defaults",
    """
    SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, -1) AS quality
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
)
def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    loaded = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return keyed.fill_defaults(loaded, {"toxic": F.lit(0), "quality": F.lit(-1)})


@query("dedup_event_id", "SELECT event_id, ts, user_id, event_type FROM events")
def dedup_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    # Every event is delivered a second time, an hour later.
    again = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return first_by_key(again.unionByName(events), ["event_id"], ["ts"])


APP_KEY = "app-key"


@query(
    "payload_hash",
    """
    SELECT sha256(event_type || props || 'app-key') AS dedup_hash, count(*) AS n,
           min(ts) AS first_ts
    FROM events GROUP BY 1
    """,
)
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("event_type", "props")
    return (
        table(spark, sf_dir, "events")
        .groupBy(dedup_hash(body, F.lit(APP_KEY)).alias("dedup_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    )


TTL_ORACLE = """
    WITH RECURSIVE kept(event_type, ts) AS (
        SELECT event_type, min(ts) FROM events GROUP BY event_type
        UNION ALL
        SELECT k.event_type, min(e.ts)
        FROM kept k JOIN events e
          ON e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 5 MINUTE
        GROUP BY k.event_type
    )
    SELECT e.event_id, e.event_type, e.ts FROM events e JOIN kept USING (event_type, ts)
"""


@query("dedup_ttl", TTL_ORACLE)
def dedup_ttl_(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return dedup_ttl(events, "event_type", "ts", "event_id", 300)


@query(
    "dedup_ttl_hot",
    TTL_ORACLE.replace("events", "timed").replace(
        "RECURSIVE", "RECURSIVE timed AS (SELECT * FROM events WHERE event_id % 10 > 0),"
    )
    + " UNION ALL SELECT event_id, event_type, NULL AS ts FROM events WHERE event_id % 10 = 0",
)
def dedup_ttl_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key cut into slices, some rows without a time, which are all kept."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    timed = some_without(events, "ts", "event_id")
    return dedup_ttl(timed, "event_type", "ts", "event_id", 300, hot_rows=1)

"""Streaming forms on the driver's tables, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.operators.dedup import last_by_key
from storeloom.operators.keyed import upsert_latest
from storeloom.plans.fixtures import TABLES, table
from storeloom.plans.inbound import InboundStream, accepted
from storeloom.plans.keyed_queries import APP_KEY, TTL_ORACLE
from storeloom.plans.registry import REGISTRY, query
from storeloom.plans.traffic_queries import LEVELS, OPTOUT_WORDS, REFUSED
from storeloom.session import work_folder
from storeloom.sources.webhooks import table_stream
from storeloom.streaming import streams
from storeloom.streaming.id_log import IdLog
from storeloom.streaming.rolling import RollingStream
from storeloom.streaming.ttl_state import TtlStream


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table_stream(spark, f"{sf_dir}/{name}.parquet*", TABLES[name])


def _partitions(spark: SparkSession) -> int:
    """State partitions: fixed for the life of a stream, so one per core here."""
    return spark.sparkContext.defaultParallelism


def _run(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    return streams.run_available(spark, stream, label, mode, _partitions(spark))


@query("stream_dedup_id", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    twice = events.unionByName(_stream(spark, sf_dir, "events").select(*events.columns))
    return _run(spark, streams.stream_first(twice, ["event_id"]), "stream_dedup_id")


TTL_COLUMNS = ["event_id", "event_type", "ts"]


def _ttl_stream(spark: SparkSession, stream: DataFrame, label: str, **rules) -> TtlStream:
    return TtlStream(
        work_folder(spark, label), stream.schema, "event_type", "ts", "event_id", 300, **rules
    )


@query("stream_dedup_ttl", TTL_ORACLE)
def stream_dedup_ttl_(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select(*TTL_COLUMNS)
    deduped = _ttl_stream(spark, events, "stream_dedup_ttl")
    deduped.start(events).awaitTermination()
    return deduped.kept(spark).drop("batch_id")


# Where the deliveries of the next two queries are cut into micro-batches.
CUTS = ["2024-01-08 00:00:00", "2024-01-12 00:00:00", "2024-01-24 00:00:00"]


def _in_batches(spark: SparkSession, events: DataFrame, batch: Column) -> DataFrame:
    """The events as a stream of one file per micro-batch, files in the order of ``batch``."""
    folder = work_folder(spark, "drops")
    parts = events.withColumn("_batch", batch)
    for n in range(len(CUTS) + 1):
        own = parts.filter(F.col("_batch") == n).drop("_batch").coalesce(1)
        own.write.mode("append").parquet(folder)
    return table_stream(spark, folder, events.schema, files_per_trigger=1)


def _turn() -> Column:
    at = F.lit(0)
    for cut in CUTS:
        at = at + (F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).cast("int")
    return at


@query("stream_dedup_ttl_batches", TTL_ORACLE)
def stream_dedup_ttl_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches in time order, their anchors folded every second one, the last
    batch done twice: the answer of one batch."""
    events = table(spark, sf_dir, "events").select(*TTL_COLUMNS)
    stream = _in_batches(spark, events, _turn())
    deduped = _ttl_stream(spark, stream, "ttl_batches", merge_every=2, horizon_seconds=86400)
    deduped.start(stream).awaitTermination()
    last = events.filter(_turn() == len(CUTS))
    deduped.step(last, len(CUTS))
    return deduped.kept(spark).drop("batch_id")


@query(
    "stream_id_log",
    f"""
    SELECT event_id, event_type, ts, FALSE AS again,
        CAST({" + ".join(f"CAST(ts >= TIMESTAMP '{c}' AS INT)" for c in CUTS)} AS BIGINT) AS batch_id
    FROM events
    """,
)
def stream_id_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of events in four micro-batches; the last delivers all of them again with later
    times and is done twice: each id stays as it first came."""
    events = table(spark, sf_dir, "events").select(*TTL_COLUMNS, F.lit(False).alias("again"))
    later = F.col("ts") + F.expr("INTERVAL 3 DAYS")
    both = events.unionByName(events.withColumns({"ts": later, "again": F.lit(True)}))
    turn = F.when(F.col("again"), len(CUTS)).otherwise(_turn())
    stream = _in_batches(spark, both, turn)
    log = IdLog(work_folder(spark, "id_log"), stream.schema, "event_id", "ts", parts=1, merge_every=2)
    log.start(stream).awaitTermination()
    log.step(both.filter(turn == len(CUTS)), len(CUTS))
    return log.kept(spark)


@query(
    "stream_ttl_late",
    f"""
    SELECT event_id, event_type, ts FROM events JOIN (
        SELECT event_type, max(ts) AS last FROM events
        WHERE ts < TIMESTAMP '{CUTS[0]}' OR ts >= TIMESTAMP '{CUTS[1]}' GROUP BY event_type)
        USING (event_type)
    WHERE ts >= TIMESTAMP '{CUTS[0]}' AND ts < TIMESTAMP '{CUTS[1]}'
      AND last >= TIMESTAMP '{CUTS[1]}'
    """,
)
def stream_ttl_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stretch of events comes after all others: its rows are late, kept apart, not lost."""
    events = table(spark, sf_dir, "events").select(*TTL_COLUMNS)
    stream = _in_batches(spark, events, F.when(_turn() == 1, len(CUTS)).otherwise(F.lit(0)))
    deduped = _ttl_stream(spark, stream, "ttl_late")
    deduped.start(stream).awaitTermination()
    return deduped.late(spark).drop("batch_id")


@query("stream_replica", REGISTRY["upsert_latest"].oracle)
def stream_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    changes = (
        _stream(spark, sf_dir, "events")
        .select(*keys, "value", *order)
        .withColumn("op", F.when(F.col("value") < 10, "delete").otherwise("edit"))
    )
    root = work_folder(spark, "stream_replica")
    with streams.streaming_settings(spark, _partitions(spark)):
        streams.write_changes(changes, root, keys, order).awaitTermination()
    target = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.lit("signup").alias("event_type"),
        F.col("c_acctbal").cast("double").alias("value"),
    )
    stored = streams.replica_changes(spark, root, changes.schema)
    return upsert_latest(target, stored, keys, order)


@query(
    "stream_rates",
    """
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS requests
    FROM events GROUP BY 1, 2
    """,
)
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    counted = streams.stream_rates(requests, "ts", "event_type", "1 hour", "10 minutes")
    out = _run(spark, counted, "stream_rates", "update")
    # A window that grew in several batches is reported by each; the last one counts.
    return last_by_key(out, ["window_start", "event_type"], ["batch_id"]).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "requests"
    )


@query(
    "stream_rate_levels",
    """
    WITH e AS (SELECT date_trunc('hour', ts) AS window_start, user_id, event_type FROM events),
    counted AS (
        SELECT 'shop' AS level, CAST(user_id AS VARCHAR) AS key, window_start,
               count(*) AS requests, 1 AS max_requests, 633 AS code FROM e GROUP BY 1, 2, 3
        UNION ALL SELECT 'ip', event_type, window_start, count(*), 5, 133 FROM e GROUP BY 1, 2, 3
        UNION ALL SELECT 'app', 'all', window_start, count(*), 20, 533 FROM e GROUP BY 1, 2, 3
    )
    SELECT level, key, window_start, requests, max_requests,
           CASE WHEN requests > max_requests THEN code END AS breach_code
    FROM counted
    """,
)
def stream_rate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.lit("all").alias("app")
    )
    counted = streams.stream_rate_levels(requests, "ts", LEVELS, "1 hour", "10 minutes")
    out = _run(spark, counted, "stream_rate_levels", "update")
    last = last_by_key(out, ["window_start", "level", "key"], ["batch_id"]).drop("batch_id")
    return last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_rolling", REGISTRY["rate_rolling_per_key"].oracle)
def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing counts in four micro-batches, each with the last hour before it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    stream = _in_batches(spark, events, _turn())
    rolling = RollingStream(work_folder(spark, "rolling"), stream.schema, "ts", 3600, 5, "event_type")
    rolling.start(stream).awaitTermination()
    return rolling.counted(spark).drop("batch_id", "event_type")


# Half a day off the orders' dates, so that no interval ends just at the watermark.
WAIT, UNTIL = "732 HOURS", "2172 HOURS"
_CLOSED = f"""o_orderdate + INTERVAL {WAIT} < (SELECT least(
    max(o_orderdate) FILTER (o_orderstatus = 'P'), max(o_orderdate) FILTER (o_orderstatus = 'F'))
    - INTERVAL 1 HOUR FROM orders)"""


def _order_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders that wait for a payment, and payments, each a stream of its own."""
    at = F.col("o_orderdate").cast("timestamp")
    waiting = _stream(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    paid = _stream(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return (
        waiting.select("o_orderkey", "o_custkey", at.alias("created")),
        paid.select("o_custkey", at.alias("paid_at")),
    )


@query(
    "stream_recovery",
    f"""
    SELECT o_orderkey, o_custkey, o_orderdate AS created FROM orders p
    WHERE o_orderstatus = 'P' AND {_CLOSED} AND NOT EXISTS (
        SELECT 1 FROM orders f WHERE f.o_orderstatus = 'F' AND f.o_custkey = p.o_custkey
           AND f.o_orderdate > p.o_orderdate AND f.o_orderdate <= p.o_orderdate + INTERVAL {WAIT})
    """,
)
def stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, payments = _order_streams(spark, sf_dir)
    unpaid = streams.stream_recovery(pending, payments, "o_custkey", "created", "paid_at", WAIT)
    out = _run(spark, unpaid, "stream_recovery")
    return out.withColumn("created", F.col("created").cast("timestamp_ntz"))


@query(
    "stream_late_payments",
    f"""
    SELECT p.o_orderkey, p.o_custkey, p.o_orderdate AS created, f.o_orderdate AS late_at
    FROM orders p JOIN orders f ON f.o_orderstatus = 'F' AND f.o_custkey = p.o_custkey
        AND f.o_orderdate > p.o_orderdate + INTERVAL {WAIT}
        AND f.o_orderdate <= p.o_orderdate + INTERVAL {UNTIL}
    WHERE p.o_orderstatus = 'P'
    """,
)
def stream_late_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, payments = _order_streams(spark, sf_dir)
    late = streams.stream_late_payments(pending, payments, "o_custkey", "created", "paid_at", WAIT, UNTIL)
    out = _run(spark, late, "stream_late_payments")
    for c in ("created", "late_at"):
        out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out


@query(
    "stream_purge",
    """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (
        SELECT user_id FROM events WHERE contains(props, '40'))
    """,
)
def stream_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    events = _stream(spark, sf_dir, "events")
    return streams.purge_on_failures(
        spark, events, customers, "c_custkey", "user_id", "props", "40"
    )


@query(
    "stream_optout",
    f"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND {REFUSED}",
)
def stream_optout(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _stream(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    refused = streams.stream_optouts(messages, "text", OPTOUT_WORDS, "first_token")
    return _run(spark, refused.select("conv_id", "turn"), "stream_optout")


@query(
    "stream_failures",
    "SELECT event_id, user_id, props FROM events WHERE event_type = 'error' AND contains(props, '40')",
)
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _stream(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    gone = streams.stream_failures(errors, "props", "40")
    return _run(spark, gone.select("event_id", "user_id", "props"), "stream_failures")


ACCEPTED_ORACLE = """
    WITH RECURSIVE deliveries AS (
        SELECT event_id, event_type || props AS body, ts FROM events
        UNION ALL SELECT event_id, event_type || props, ts + INTERVAL 1 HOUR FROM events
        UNION ALL SELECT -event_id - 1, event_type || props, ts + INTERVAL 1 MINUTE FROM events
    ), kept(body, ts) AS (
        SELECT body, min(ts) FROM deliveries GROUP BY body
        UNION ALL
        SELECT k.body, min(d.ts) FROM kept k JOIN deliveries d
          ON d.body = k.body AND d.ts >= k.ts + INTERVAL 5 MINUTE
        GROUP BY k.body
    )
    SELECT event_id, min(ts) AS ts FROM (
        SELECT min(event_id) AS event_id, ts FROM deliveries JOIN kept USING (body, ts)
        GROUP BY body, ts)
    GROUP BY event_id
"""


def _deliveries(events: DataFrame) -> DataFrame:
    """Each event comes three times: as it is, an hour later with the same id, and a
    minute later under another id."""
    body = F.concat("event_type", "props").alias("body")
    first = events.select("event_id", "ts", body)
    later = events.select("event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), body)
    renamed = events.select(
        (-F.col("event_id") - 1).alias("event_id"),
        (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"),
        body,
    )
    return first.unionByName(later).unionByName(renamed)


@query("inbound_events", ACCEPTED_ORACLE)
def inbound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = _deliveries(table(spark, sf_dir, "events"))
    return accepted(deliveries, APP_KEY, "event_id", "ts", "body").select("event_id", "ts")


@query("stream_inbound", ACCEPTED_ORACLE)
def stream_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = _deliveries(_stream(spark, sf_dir, "events"))
    inbound = InboundStream(
        deliveries, work_folder(spark, "stream_inbound"), APP_KEY, "event_id", "ts", "body"
    )
    inbound.start().awaitTermination()
    return inbound.accepted(spark).select("event_id", "ts")

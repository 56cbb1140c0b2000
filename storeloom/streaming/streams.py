"""Streaming forms of the batch operators, and how to run them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storeloom.operators.catalog import purge
from storeloom.operators.dedup import last_by_key
from storeloom.operators.ops import GONE_CODE, failures
from storeloom.operators.privacy import OPTOUT_WORDS, refusal
from storeloom.operators.rates import API_LEVELS, Level
from storeloom.session import work_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_first(
    stream: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None
) -> DataFrame:
    """First delivery of each key.

    Without ``delay`` the answer is exact and the state keeps every key ever seen (on
    disk, with RocksDB).  With it, keys are forgotten once the watermark on ``ts`` has
    passed them, so a repeat that comes later than that gets through.
    """
    if delay is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_rates(
    stream: DataFrame, ts: str, key: str, width: str = "1 minute", delay: str = "5 minutes"
) -> DataFrame:
    """Requests per window and key; rows later than ``delay`` no longer count."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width), F.col(key))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("window_start"), key, "requests")
    )


def stream_rate_levels(
    stream: DataFrame,
    ts: str,
    levels: Sequence[Level] = API_LEVELS,
    width: str = "1 minute",
    delay: str = "5 minutes",
) -> DataFrame:
    """Requests per window at every level, with the error code where a limit is passed.

    A request becomes a row per level and all levels share one state.  Requests later than
    ``delay`` no longer count; those without a time have no window and are left out.
    """
    lines = [
        F.struct(
            F.lit(x.name).alias("level"),
            F.col(x.column).cast("string").alias("key"),
            F.lit(x.limit).alias("max_requests"),
            F.lit(x.code).alias("code"),
        )
        for x in levels
    ]
    counted = (
        stream.withWatermark(ts, delay)
        .select(ts, F.inline(F.array(*lines)))
        .groupBy(F.window(ts, width), "level", "key", "max_requests", "code")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    passed = F.col("requests") > F.col("max_requests")
    return counted.select(
        "level",
        "key",
        F.col("window.start").alias("window_start"),
        "requests",
        "max_requests",
        F.when(passed, F.col("code")).alias("breach_code"),
    )


def purge_on_failures(
    spark: SparkSession,
    stream: DataFrame,
    entries: DataFrame,
    row_id: str,
    failed_id: str,
    message: str,
    needle: str = GONE_CODE,
) -> DataFrame:
    """The entries left after all failure reports there are: those marked as gone are away.

    Reports are filtered as they arrive and reduced to their ids per micro-batch, so the
    join with the entries meets one row per failing entry.
    """
    gone = stream_failures(stream, message, needle).select(F.col(failed_id), F.col(message))
    reports = run_available(spark, gone, "failures")
    return purge(entries, reports, row_id, failed_id, message, needle)


def stream_recovery(
    pending: DataFrame,
    payments: DataFrame,
    key: str,
    created: str,
    paid_at: str,
    wait: str,
    delay: str = "1 hour",
) -> DataFrame:
    """Pending orders that were not paid within ``wait``, as soon as that is certain.

    An order waits in the state until both streams have passed the end of its interval, by
    more than ``delay``; payments wait until no order can need them.  Rows later than
    ``delay`` behind the newest take no part.  The customer's row spreads by the key, so
    what a task holds are the open intervals of its customers.
    """
    orders = pending.withWatermark(created, delay)
    paid = payments.select(F.col(key).alias("_payer"), F.col(paid_at).alias("_paid_at")).withWatermark(
        "_paid_at", delay
    )
    in_time = (
        (F.col(key) == F.col("_payer"))
        & (F.col("_paid_at") > F.col(created))
        & (F.col("_paid_at") <= F.col(created) + F.expr(f"INTERVAL {wait}"))
    )
    return orders.join(paid, in_time, "leftOuter").filter(F.col("_payer").isNull()).select(*pending.columns)


def stream_late_payments(
    pending: DataFrame,
    payments: DataFrame,
    key: str,
    created: str,
    paid_at: str,
    wait: str,
    until: str,
    delay: str = "1 hour",
) -> DataFrame:
    """Payments that came after ``wait``, when a reminder was out, but within ``until``: with
    the order's columns, one row for each payment and order."""
    orders = pending.withWatermark(created, delay)
    paid = payments.select(F.col(key).alias("_payer"), F.col(paid_at).alias("late_at")).withWatermark(
        "late_at", delay
    )
    after = (
        (F.col(key) == F.col("_payer"))
        & (F.col("late_at") > F.col(created) + F.expr(f"INTERVAL {wait}"))
        & (F.col("late_at") <= F.col(created) + F.expr(f"INTERVAL {until}"))
    )
    return orders.join(paid, after).select(*pending.columns, "late_at")


def stream_optouts(
    stream: DataFrame, text: str, words: Sequence[str] = OPTOUT_WORDS, mode: str = "message"
) -> DataFrame:
    """Refusal messages as they arrive."""
    return stream.filter(refusal(F.col(text), words, mode))


def stream_failures(stream: DataFrame, message: str, needle: str = GONE_CODE) -> DataFrame:
    """Failure reports with the code as they arrive."""
    return failures(stream, message, needle)


def write_changes(
    stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], **trigger
) -> StreamingQuery:
    """Keep a replica current: per micro-batch store the last change of each key.

    A batch writes only its own changes, into a folder named by its batch id, so the
    cost follows the batch and not the replica, and a repeated batch replaces itself.
    ``replica_changes`` reads them back; ``upsert_latest`` applies them.  ``trigger`` is
    what Spark's ``trigger`` takes; without it the query ends when all there is has been
    read.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        last_by_key(batch, keys, order).write.mode("overwrite").parquet(
            f"{root}/changes/batch_id={batch_id}"
        )

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def merge_changes(
    spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], upto: int
) -> None:
    """Fold the changes of all batches up to ``upto`` into one set with a row per key."""
    changes = replica_changes(spark, root, schema, upto=upto)
    last_by_key(changes, keys, order).write.mode("overwrite").parquet(f"{root}/merged_{upto}")


def replica_changes(
    spark: SparkSession, root: str, schema: T.StructType, merged: int | None = None, upto: int | None = None
) -> DataFrame:
    """Stored changes; with ``merged`` the folded set and only the batches after it."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    batches = spark.read.schema(with_batch).parquet(f"{root}/changes")
    if upto is not None:
        batches = batches.filter(F.col("batch_id") <= upto)
    if merged is None:
        return batches.drop("batch_id")
    folded = spark.read.schema(schema).parquet(f"{root}/merged_{merged}")
    return folded.unionByName(batches.filter(F.col("batch_id") > merged).drop("batch_id"))


@contextmanager
def streaming_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """RocksDB state and, if given, the number of state partitions, while starting."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(
    spark: SparkSession,
    stream: DataFrame,
    label: str,
    mode: str = "append",
    partitions: int | None = None,
) -> DataFrame:
    """Process what is there now and return the output as a batch frame.

    Every micro-batch writes its own folder; with ``update`` a row may come again in a
    later batch, told apart by ``batch_id``.
    """
    root = work_folder(spark, label)
    schema = stream.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    with streaming_settings(spark, partitions):
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(store)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    out = spark.read.schema(with_batch).parquet(f"{root}/out")
    return out if mode == "update" else out.drop("batch_id")

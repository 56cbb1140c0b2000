"""The outbound message queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.hot import HOT_ROWS
from storeloom.functions.ordered import running_count

# Fixed value: the status of a message that waits to be sent.
PENDING = "pendente"

# Parts a worker's queue is cut into before its oldest messages are known.
PARTS = 64


def claim(
    queue: DataFrame,
    as_of: Column,
    workers: int,
    per_worker: int,
    row_id: str,
    due: str,
    status: str,
    pending: str = PENDING,
    attempts: str | None = None,
    max_attempts: int | None = None,
) -> DataFrame:
    """Hand due messages to workers: disjoint, each once, the oldest first.

    A message's worker follows from its id, so no two workers can claim the same one.
    There are few workers and many messages, so each worker's queue is first cut into
    parts that keep their own oldest ``per_worker`` rows (Spark applies that limit inside
    every task, before the shuffle); the worker's task orders what the parts kept.
    """
    open_ = (F.col(status) == pending) & (F.col(due) <= as_of)
    if max_attempts is not None:
        open_ = open_ & (F.col(attempts) < max_attempts)
    in_part = Window.partitionBy("worker", "_part").orderBy(due, row_id)
    oldest = Window.partitionBy("worker").orderBy(due, row_id)
    return (
        queue.filter(open_)
        .withColumns(
            {
                "worker": F.pmod(F.col(row_id), F.lit(workers)),
                "_part": F.pmod(F.xxhash64(row_id), F.lit(PARTS)),
            }
        )
        .withColumn("_turn", F.row_number().over(in_part))
        .filter(F.col("_turn") <= per_worker)
        .withColumn("turn", F.row_number().over(oldest))
        .filter(F.col("turn") <= per_worker)
        .drop("_part", "_turn")
    )


def backlog(queue: DataFrame, as_of: Column, due: str, status: str, attempts: str) -> DataFrame:
    """Messages per status and number of attempts, and since when the oldest is due."""
    return (
        queue.groupBy(status, attempts)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(due) <= as_of).alias("n_due"),
            F.min(due).alias("oldest_due"),
        )
        .withColumn("oldest_age_days", F.datediff(as_of, F.col("oldest_due")))
    )


def drain_plan(
    requests: DataFrame,
    key: str,
    order: Sequence[str],
    bucket: Column,
    limit: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Spread waiting requests over minutes so that no key exceeds its limit.

    Each request gets the minute (``slot``) in which it may be sent.
    """
    by_order = [F.col(c) for c in order]
    placed = running_count(requests, [key], bucket, by_order, "_place", hot_rows)
    return placed.withColumn("slot", F.floor((F.col("_place") - 1) / F.lit(limit))).drop("_place")

"""Counting requests against rate limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.clock import micros
from storeloom.functions.hot import HOT_ROWS, hot_keys, mark_hot


@dataclass(frozen=True)
class Level:
    """A limit on the requests per window that share one value of ``column``."""

    name: str
    column: str
    limit: int
    code: int


# Requests a minute per shop, host address and application, with the
# error code reported when the limit is passed.
API_LEVELS = (
    Level("shop", "shop", 100, 633),
    Level("ip", "ip", 1200, 133),
    Level("app", "app", 3000, 533),
)


def rate_tumbling(
    requests: DataFrame, ts: str, levels: Sequence[Level] = API_LEVELS, width: str = "1 minute"
) -> DataFrame:
    """Requests per window at every level, with the error code where a limit is passed.

    All levels share one grouping-sets aggregation, combined before the shuffle.  Requests
    without a time are counted too, in a window whose start is null.
    """
    columns = [level.column for level in levels]
    named = [F.col(c).cast("string").alias(c) for c in columns]
    timed = requests.select(F.window(F.col(ts), width).start.alias("window_start"), *named)
    start = timed.schema["window_start"].dataType
    slim = timed.unionByName(
        requests.filter(F.col(ts).isNull()).select(
            F.lit(None).cast(start).alias("window_start"), *named
        )
    )
    counted = slim.groupingSets(
        [["window_start", c] for c in columns], "window_start", *columns
    ).agg(F.count(F.lit(1)).alias("requests"), F.grouping_id().alias("_set"))
    # grouping_id has a bit per grouping column, 0 where the column is part of the set.
    n = len(levels)
    full = (1 << n) - 1

    def by_level(value) -> Column:
        picked = None
        for i, level in enumerate(levels):
            mine = F.col("_set") == (full & ~(1 << (n - 1 - i)))
            picked = (
                F.when(mine, value(level)) if picked is None else picked.when(mine, value(level))
            )
        return picked

    passed = F.col("requests") > F.col("max_requests")
    return (
        counted.select(
            by_level(lambda level: F.lit(level.name)).alias("level"),
            by_level(lambda level: F.col(level.column)).alias("key"),
            "window_start",
            "requests",
            by_level(lambda level: F.lit(level.limit)).alias("max_requests"),
            by_level(lambda level: F.lit(level.code)).alias("_code"),
        )
        .withColumn("breach_code", F.when(passed, F.col("_code")))
        .drop("_code")
    )


def rate_rolling(
    requests: DataFrame,
    ts: str,
    width_seconds: int,
    limit: int,
    key: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For every request, the requests of its key in the trailing window up to it.

    A request adds one to its key's count when it comes and takes it away again when it
    leaves the window, so a running sum over both answers all requests in one sorted
    pass.  The window is open at its far end: exactly ``width_seconds`` ago no longer
    counts.  Requests without a time stay, uncounted.

    Requests of hot keys (without ``key``, of the whole application) are first counted
    per instant, and their time is cut into slices one window long.  What leaves during
    a slice came during the slice before, so each slice is a task of its own.
    """
    width = width_seconds * 1_000_000
    keys = [] if key is None else [key]
    clocked = requests.withColumn("_us", micros(requests, ts))
    if key is None:
        counted = _rolling_hot(clocked, keys, width)
    elif (listed := hot_keys(clocked, keys, hot_rows)) is None:
        counted = _rolling_cold(clocked, keys, width)
    else:
        marked = mark_hot(clocked, listed)
        hot = _rolling_hot(marked.filter("_hot"), keys, width)
        counted = hot.unionByName(_rolling_cold(marked.filter(~F.col("_hot")), keys, width))
    return counted.withColumn("breached", F.col("in_window") > limit).select(
        *requests.columns, "in_window", "breached"
    )


def _rolling_cold(clocked: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One window over each key's requests and their leaving."""
    adds = F.when(F.col("_us").isNotNull(), 1).otherwise(0)
    coming = clocked.withColumns({"_n": adds, "_row": F.lit(True)})
    leaving = clocked.filter(F.col("_us").isNotNull()).select(
        *keys, (F.col("_us") + width).alias("_us"), F.lit(-1).alias("_n")
    )
    # Peers of the frame are all rows of an instant: what leaves then is gone already.
    up_to = Window.partitionBy(*keys).orderBy("_us")
    counted = coming.unionByName(leaving, allowMissingColumns=True).withColumn(
        "in_window", F.when(F.col("_us").isNotNull(), F.sum("_n").over(up_to))
    )
    return counted.filter("_row").drop("_n", "_row")


def _rolling_hot(clocked: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Counts per instant, slice by slice, joined back to the requests."""
    names = [f"_of_{k}" for k in keys]
    instants = (
        clocked.filter(F.col("_us").isNotNull())
        .groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_us").alias("_at"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    none = F.lit(0).cast("bigint")

    def change(at: Column, come: Column, go: Column) -> Column:
        return F.struct(at.alias("_at"), come.alias("_come"), go.alias("_go"))

    changes = F.array(
        change(F.col("_at"), F.col("_n"), none), change(F.col("_at") + width, none, F.col("_n"))
    )
    pieces = instants.select(*names, F.inline(changes)).withColumn(
        "_slice", F.floor(F.col("_at") / F.lit(width))
    )
    in_slice = Window.partitionBy(*names, "_slice")
    up_to = in_slice.orderBy("_at")
    counted = (
        pieces.withColumn(
            "in_window",
            F.sum("_go").over(in_slice) + F.sum(F.col("_come") - F.col("_go")).over(up_to),
        )
        .filter(F.col("_come") > 0)
        .drop("_come", "_go", "_slice")
    )
    same = F.col("_us") == F.col("_at")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return clocked.join(counted, same, "left").drop(*names, "_at")

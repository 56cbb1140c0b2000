"""Operations data: failures, history, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The error code of a vanished entry; age and size limits of the history.
GONE_CODE = "404"
HISTORY_DAYS = 14
HISTORY_ROWS = 50_000

# What rate-limit lines look like, and how they are reported.
RATE_LIMIT_LINE = r"(?i)retry after|too many certificates|acme: error: 429|rate limit"
RETRY_AT = r".*retry after ([0-9-]* [0-9:]*) UTC"
REASON = r"(too many.*|rate limit.*)"
DEFAULT_REASON = "Bloqueio ACME 429"
LOCAL_FORMAT = "dd/MM/yyyy 'às' HH:mm:ss"


def failures(df: DataFrame, message: str, needle: str = GONE_CODE) -> DataFrame:
    """Failure reports whose message contains the code (case matters)."""
    return df.filter(F.col(message).contains(needle))


def failure_counts(df: DataFrame, item: str, message: str, needle: str = GONE_CODE) -> DataFrame:
    """Matching failures per item."""
    return failures(df, message, needle).groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def prune(
    df: DataFrame,
    ts: str,
    row_id: str,
    as_of: Column,
    days: int = HISTORY_DAYS,
    max_rows: int = HISTORY_ROWS,
) -> DataFrame:
    """History younger than ``days`` and among the newest ``max_rows`` rows.

    A count per minute (at most ``days`` x 1,440 rows) tells in which minute the limit
    is reached.  Only rows from that minute on take part in the top-k, so the single
    task that ends it sees little more than the rows it keeps.
    """
    recent = df.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {days} DAYS"))
    minute = F.window(F.col(ts), "1 minute").start
    newer = (
        Window.orderBy(F.col("_minute").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    per_minute = recent.groupBy(minute.alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    oldest_needed = (
        per_minute.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .filter(F.col("_newer") < max_rows)
        .agg(F.min("_minute"))
    )
    return (
        recent.filter(F.col(ts) >= oldest_needed.scalar())
        .orderBy(F.col(ts).desc(), F.col(row_id).desc())
        .limit(max_rows)
    )


def rate_limit_log(
    df: DataFrame, source: str, pos: str, line: str, tz: str = "America/Sao_Paulo"
) -> DataFrame:
    """Per source the last rate-limit line: when to retry (UTC and local), or why.

    Lines are filtered first and combined before the shuffle.
    """
    last = (
        df.filter(F.col(line).rlike(RATE_LIMIT_LINE))
        .groupBy(source)
        .agg(F.max_by(line, pos).alias("line"), F.count(F.lit(1)).alias("n_lines"))
    )
    text = F.nullif(F.regexp_extract("line", RETRY_AT, 1), F.lit(""))
    retry = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    local = F.date_format(
        F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("retry_at_utc")), LOCAL_FORMAT
    )
    has_retry = F.col("line").rlike("(?i)retry after")
    reason = F.coalesce(
        F.nullif(F.regexp_extract("line", REASON, 1), F.lit("")), F.lit(DEFAULT_REASON)
    )
    return last.withColumn("retry_at_utc", retry).select(
        source,
        "n_lines",
        "retry_at_utc",
        F.when(
            has_retry, F.coalesce(local, F.concat(F.coalesce(text, F.lit("")), F.lit(" (UTC)")))
        ).alias("retry_local"),
        F.when(~has_retry, reason).alias("reason"),
    )

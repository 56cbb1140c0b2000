"""Time arithmetic on wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 as a long.

    A ``timestamp_ntz`` is counted field by field, so the answer does not depend on
    the session's time zone.
    """
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.TimestampType):
        return F.unix_micros(c)
    seconds = (
        F.unix_date(c.cast("date")).cast("long") * 86400
        + F.hour(c) * 3600
        + F.minute(c) * 60
    )
    in_minute = F.date_part(F.lit("SECOND"), c) * 1000000
    return seconds * 1000000 + in_minute.cast("long")


def minutes(df: DataFrame, col: str) -> Column:
    """Minutes since 1970-01-01; null stays null, which a window function would drop."""
    return F.floor(micros(df, col) / 60_000_000)


def weeks_starting(ts: Column, offset: str) -> Column:
    """Start of the seven-day window holding ``ts``; 1970-01-05 was a Monday."""
    return F.window(ts, "7 days", "7 days", offset).start

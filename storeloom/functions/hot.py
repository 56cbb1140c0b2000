"""Telling hot keys from the rest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is worked on in pieces; up to it, one task takes all of
# a key's rows.
HOT_ROWS = 1_000_000
# Rows of a key at the threshold that the look for hot keys is to see.
SEEN_ROWS = 1_000
_SEED = 17


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than about ``hot_rows`` rows, or None if there are none.

    Looks at a sample of the key columns, large enough to tell such keys (with
    ``hot_rows`` up to ``SEEN_ROWS`` it looks at all rows).  Which keys are called hot
    decides how rows are spread over tasks, never what comes out.  The list has at most
    about (all rows / ``hot_rows``) entries, a thousand per billion rows; it is fetched
    once, so that all parts of a plan see the same one.
    """
    share = min(1.0, SEEN_ROWS / max(hot_rows, 1))
    seen = df.select(*keys)
    if share < 1.0:
        seen = seen.sample(share, _SEED)
    counted = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = counted.filter(F.col("_rows") > hot_rows * share).select(*keys).collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, counted.select(*keys).schema)


def mark_hot(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Add ``_hot``: whether the row's key is in the list.  Null is a key like others.

    The list is broadcast; ``hot_keys`` says how small it is.
    """
    keys = hot.columns
    listed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]).withColumn("_hot", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return (
        df.join(F.broadcast(listed), same, "left")
        .drop(*[f"_hot_{k}" for k in keys])
        .withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    )

"""Ordered computations inside a key that may hold most of the rows.

A plain ``partitionBy(key)`` window sends all rows of a key to one task.  That is fine
for most keys; the rows of a hot one are first cut into buckets along the order column,
every (key, bucket) is worked on by itself, and only one total per bucket is carried
along the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.hot import HOT_ROWS, hot_keys, mark_hot


LOWEST = -(2**63)


def place_of(bucket: Column) -> Column:
    """The bucket as a long, a null one as the lowest."""
    return F.coalesce(bucket.cast("long"), F.lit(LOWEST))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    measure: Column,
    out: str,
    newest_first: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``measure`` over the key's rows up to and with this one.

    ``bucket``, a number, must move with ``order``: every row of a lower bucket sorts before
    every row of a higher one (the other way round with ``newest_first``).  Where the order
    is null the bucket is to be null too; such rows form the lowest bucket, as they sort
    first (last with ``newest_first``).  What the earlier buckets of a hot key add up to
    comes in as one more row at the head of each bucket, so the rows are shuffled once, on
    the key and, for a hot key, the bucket.
    """
    from_start = (Window.unboundedPreceding, 0)
    if keys:
        hot = hot_keys(df, keys, hot_rows)
        if hot is None:
            whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*from_start)
            return df.withColumn(out, F.sum(measure).over(whole))
        marked = mark_hot(df, hot)
    else:
        marked = df.withColumn("_hot", F.lit(True))
    rows = marked.select(
        *df.columns,
        F.when(F.col("_hot"), place_of(bucket)).alias("_bucket"),
        measure.alias("_measure"),
        F.lit(False).alias("_head"),
    )
    totals = (
        rows.filter(F.col("_bucket").isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.sum("_measure").alias("_total"))
    )
    along = F.col("_bucket").desc() if newest_first else F.col("_bucket").asc()
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_measure"),
        F.lit(True).alias("_head"),
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.col("_head").desc(), *order)
        .rowsBetween(*from_start)
    )
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn(out, F.sum("_measure").over(inside))
        .filter(~F.col("_head"))
        .drop("_bucket", "_measure", "_head")
    )


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the row's place (from 1) among the rows of its key."""
    return running_sum(df, keys, bucket, order, F.lit(1), out, hot_rows=hot_rows)

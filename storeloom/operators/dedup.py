"""Removing repeated deliveries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeloom.functions.clock import micros
from storeloom.functions.hot import HOT_ROWS, hot_keys, mark_hot
from storeloom.functions.ttl_slices import carry, keep_first, slice_kept, slice_steps


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of every key; rows with a null in their key are all kept.

    Spark keeps one row per key inside every task before the shuffle, so a key with many
    copies sends one row per task.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    first = _one_by_key(df.filter(known), keys, [F.col(c).asc() for c in order])
    if not any(df.schema[c].nullable for c in keys):
        return first
    return first.unionByName(df.filter(~known))


def last_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of every key, also limited before the shuffle."""
    return _one_by_key(df, keys, [F.col(c).desc() for c in order])


def _one_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def dedup_hash(body: Column, app_key: Column) -> Column:
    """SHA-256 of the payload body followed by the application key."""
    return F.sha2(F.concat(body, app_key), 256)


# Slices of a hot key's time line are this many TTLs long.
SLICE_TTLS = 8


def dedup_ttl(
    df: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    ttl_seconds: int,
    slice_ttls: int = SLICE_TTLS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Drop rows whose key was already kept less than the TTL ago.

    The TTL runs from the row that was kept and is not renewed by dropped copies, so
    what is kept depends on the whole past of the key.  Rows are sorted by key and time
    and followed in one pass that remembers a single instant; keys with very many rows
    are cut into slices of time instead (``_hot_kept``).  Of several rows at one kept
    instant the lowest id stays.  Rows with a null key or time cannot be compared and
    are all kept.
    """
    ttl = ttl_seconds * 1_000_000
    clocked = df.withColumn("_us", micros(df, ts))
    comparable = F.col(key).isNotNull() & F.col("_us").isNotNull()
    rows = clocked.filter(comparable)
    loose = clocked.filter(~comparable).drop("_us")
    listed = hot_keys(rows, [key], hot_rows)
    if listed is None:
        return _sorted_kept(rows, key, row_id, ttl).unionByName(loose)
    marked = mark_hot(rows, listed)
    cold = marked.filter(~F.col("_hot")).drop("_hot")
    hot = marked.filter("_hot").drop("_hot")
    return (
        _sorted_kept(cold, key, row_id, ttl)
        .unionByName(_hot_kept(hot, key, row_id, ttl, ttl * slice_ttls))
        .unionByName(loose)
    )


def _sorted_kept(rows: DataFrame, key: str, row_id: str, ttl: int) -> DataFrame:
    """One shuffle by key, one sorted pass."""
    kept = T.StructType([f for f in rows.schema.fields if f.name != "_us"])
    return (
        rows.repartition(key)
        .sortWithinPartitions(key, "_us", row_id)
        .mapInArrow(lambda batches: keep_first(batches, key, ttl), kept)
    )


def _hot_kept(rows: DataFrame, key: str, row_id: str, ttl: int, width: int) -> DataFrame:
    """Keys with very many rows, a slice of their time line at a time.

    Every (key, slice) is reduced to its distinct instants.

    1. Every slice on its own works out, for each point at which counting could resume,
       the last instant it would keep - a step function with few steps.
    2. One light pass per key strings the step functions together, giving each slice
       the instant from which it may keep something again.
    3. Every slice then lists what it keeps.
    """
    slices = rows.groupBy(key, F.floor(F.col("_us") / F.lit(width)).alias("_slice")).agg(
        F.sort_array(F.collect_set("_us")).alias("_at")
    )
    key_field = T.StructField(key, rows.schema[key].dataType)
    slice_field = T.StructField("_slice", T.LongType())
    instants = T.ArrayType(T.LongType())
    steps = slices.mapInArrow(
        lambda batches: slice_steps(batches, ttl, width),
        T.StructType(
            [key_field, slice_field, T.StructField("_upto", instants), T.StructField("_exit", instants)]
        ),
    )
    carried = (
        steps.repartition(key)
        .sortWithinPartitions(key, "_slice")
        .mapInArrow(
            lambda batches: carry(batches, ttl),
            T.StructType([key_field, slice_field, T.StructField("_since", T.LongType())]),
        )
    )
    kept = slices.join(carried, [key, "_slice"]).mapInArrow(
        lambda batches: slice_kept(batches, ttl),
        T.StructType([key_field, T.StructField("_us", T.LongType())]),
    )
    firsts = first_by_key(rows, [key, "_us"], [row_id])
    return firsts.join(kept, [key, "_us"], "left_semi").select(
        *[c for c in rows.columns if c != "_us"]
    )

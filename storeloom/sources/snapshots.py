"""Dated full snapshots of tables: write, verify, restore, retain."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: days a snapshot is kept.
RETENTION_DAYS = 7
DATE_COLUMN = "snapshot_date"
LOG = "finished_snapshots"


_LOG_SCHEMA = f"table_name STRING, {DATE_COLUMN} DATE, path STRING, logged_at BIGINT"


def write_snapshot(
    tables: Mapping[str, DataFrame], root: str, date: str, log: bool = True
) -> dict[str, str]:
    """Write each table to a dated folder below ``root`` and note it in the log.

    Each table is one parallel parquet write.  A finished snapshot is never written over:
    a further run of the same day gets folders of its own, and the log, written last, says
    which one counts.  So a run that breaks leaves the former one in force.  Without ``log``
    the caller notes the returned folders (by table, relative to ``root``) when they are
    checked.
    """
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    paths = {}
    for name, df in tables.items():
        folder = f"{name}/{DATE_COLUMN}={date}"
        if _finished(spark, root, name, date) is not None:
            folder = f"reruns/{uuid.uuid4().hex}/{folder}"
        df.write.mode("overwrite").parquet(f"{root}/{folder}")
        paths[name] = folder
    if log:
        finish_snapshot(spark, root, date, paths)
    return paths


def finish_snapshot(spark: SparkSession, root: str, date: str, paths: Mapping[str, str]) -> None:
    """Note written folders as the snapshot of their date."""
    done = [(name, date, path) for name, path in paths.items()]
    schema = f"table_name STRING, {DATE_COLUMN} STRING, path STRING"
    log_snapshots(spark.createDataFrame(done, schema), root)


def log_snapshots(done: DataFrame, root: str) -> None:
    """Note (table_name, snapshot_date[, path]) rows in the log of finished snapshots."""
    path = F.col("path") if "path" in done.columns else F.lit(None).cast("string")
    done.select(
        "table_name",
        F.col(DATE_COLUMN).cast("date"),
        path.alias("path"),
        F.lit(time.time_ns()).alias("logged_at"),
    ).write.mode("append").parquet(f"{root}/{LOG}")


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    """The log; None before the first entry."""
    try:
        return spark.read.schema(_LOG_SCHEMA).parquet(f"{root}/{LOG}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _finished(spark: SparkSession, root: str, name: str, date: str | None = None):
    """(date, folder) of the newest finished snapshot of a table, or None."""
    log = _log(spark, root)
    if log is None:
        return None
    mine = log.filter(F.col("table_name") == name)
    if date is not None:
        mine = mine.filter(F.col(DATE_COLUMN) == F.lit(date).cast("date"))
    newest = mine.agg(F.max(F.struct(DATE_COLUMN, F.coalesce("logged_at", F.lit(0)), "path"))).first()[0]
    if newest is None:
        return None
    return newest[0], newest[2] or f"{name}/{DATE_COLUMN}={newest[0]}"


def read_snapshot(
    spark: SparkSession, root: str, name: str, date: str, path: str | None = None
) -> DataFrame:
    """One dated snapshot, read from its own folder (the one in force, unless given)."""
    if path is None:
        found = _finished(spark, root, name, date)
        path = f"{name}/{DATE_COLUMN}={date}" if found is None else found[1]
    return spark.read.parquet(f"{root}/{path}")


def latest_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest finished snapshot of a table, for restore.

    The log says which it is; the folders of other dates are not even listed.
    """
    found = _finished(spark, root, name)
    if found is None:
        raise FileNotFoundError(f"no snapshot of {name!r} below {root}")
    path = f"{root}/{found[1]}"
    return spark.read.option("basePath", path.rpartition("/")[0]).parquet(path)


def latest_partition(df: DataFrame, date: str) -> DataFrame:
    """Rows of the newest date; on a partition column the other dates are not read."""
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())


def content_checksum(df: DataFrame) -> Column:
    """Order-free checksum of all rows: the sums of both halves of their hashes."""
    row = F.xxhash64(*sorted(df.columns))
    halves = (F.shiftright(row, 32), row.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.struct(*[F.sum(h).alias(f"half_{i}") for i, h in enumerate(halves)])


def verify_snapshot(
    source: Mapping[str, DataFrame], snapshot: Mapping[str, DataFrame]
) -> DataFrame:
    """One row per table: rows on either side, and whether schema and contents agree.

    Every table is scanned once per side; only its row count and checksum are compared.
    """
    lines = []
    for name, src in source.items():
        snap = snapshot[name]
        same_schema = [(f.name, f.dataType) for f in src.schema.fields] == [
            (f.name, f.dataType) for f in snap.schema.fields
        ]
        sides = [
            df.agg(F.count(F.lit(1)).alias("n"), content_checksum(df).alias("h")).select(
                F.lit(name).alias("table_name"), F.lit(i).alias("side"), "n", "h"
            )
            for i, df in enumerate((src, snap))
        ]
        lines.append(
            sides[0].unionByName(sides[1]).withColumn("same_schema", F.lit(same_schema))
        )

    def of(side: int, col: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(col)))

    return (
        reduce(DataFrame.unionByName, lines)
        .groupBy("table_name")
        .agg(
            of(0, "n").alias("n_source"),
            of(1, "n").alias("n_snapshot"),
            (
                (of(0, "n") == of(1, "n"))
                & of(0, "h").eqNullSafe(of(1, "h"))
                & F.bool_and("same_schema")
            ).alias("matches"),
        )
    )


def retention(
    snapshots: DataFrame, date: str, as_of: Column, days: int = RETENTION_DAYS
) -> DataFrame:
    """Each snapshot date with its age and whether it may be dropped."""
    age = F.datediff(as_of, F.col(date))
    return snapshots.select(date, age.alias("age_days"), (age > days).alias("drop_it"))

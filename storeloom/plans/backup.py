"""The nightly snapshot and its way back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.sources.snapshots import (
    finish_snapshot,
    latest_snapshot,
    read_snapshot,
    verify_snapshot,
    write_snapshot,
)


class SnapshotMismatch(RuntimeError):
    """A snapshot that does not hold what it was taken from."""


def backup(
    spark: SparkSession, tables: Mapping[str, DataFrame], root: str, date: str
) -> DataFrame:
    """Write a dated snapshot, read it back and compare; the report has a row per table.

    Only a snapshot that agrees is noted as finished, so one that doesn't is never restored.
    """
    paths = write_snapshot(tables, root, date, log=False)
    report = verify_snapshot(
        tables, {name: read_snapshot(spark, root, name, date, path) for name, path in paths.items()}
    )
    wrong = [r["table_name"] for r in report.filter(~F.col("matches")).collect()]
    if wrong:
        raise SnapshotMismatch(f"snapshot of {date} differs from its source: {wrong}")
    finish_snapshot(spark, root, date, paths)
    return report


def restore(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """The newest snapshot of each table."""
    return {name: latest_snapshot(spark, root, name) for name in names}

"""Keyed writes, column defaults and data-quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.operators.dedup import first_by_key, last_by_key


def _all_set(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Target plus the batch rows whose key is new; on conflict the old row stays.

    Within the batch the first row of a key by ``order`` goes in.  As in a UNIQUE rule,
    rows with a null in the key conflict with nothing.

    A small batch is broadcast (by Spark's own size check) to find the target's rows it
    collides with, so a large target is neither shuffled nor rewritten for it.
    """
    complete = _all_set(keys)
    fresh = first_by_key(batch.filter(complete), keys, order)
    taken = target.select(*keys).join(batch.select(*keys).distinct(), list(keys), "left_semi")
    loose = batch.filter(~complete)
    columns = target.columns
    return (
        target.unionByName(fresh.join(taken, list(keys), "left_anti").select(columns))
        .unionByName(loose.select(columns))
    )


def upsert_latest(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    op_col: str = "op",
    delete: str = "delete",
) -> DataFrame:
    """The replica after a set of create/edit/delete events: the last event per key wins.

    Rows of the target whose key changed are left out, the last state of each changed
    key is added.  Only the keys of the changes meet the target, broadcast if they are
    few, so a small set of changes does not shuffle a large target.  A null in a key is a
    value like others, so that the same changes can be applied again.
    """
    last = last_by_key(changes, keys, order)
    live = last.filter(~F.coalesce(F.col(op_col) == delete, F.lit(False)))
    changed = changes.select(*[F.col(k).alias(f"_changed_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_changed_{k}")) for k in keys])
    return target.join(changed, same, "left_anti").unionByName(live.select(target.columns))


def partial_upsert(
    target: DataFrame,
    patches: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Apply patches that carry some columns only: per column the last non-null value."""
    latest = patches.groupBy(*keys).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_new_{c}")
            for c in cols
        ]
    )
    return target.join(latest, list(keys), "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in target.columns]
    )


def fill_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Column defaults for values left out on load."""
    return df.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()})


@dataclass(frozen=True)
class RowRule:
    """A rule each row passes or breaks by itself; ``broken`` counts rows where true."""

    name: str
    column: str
    broken: Column


def not_null(col: str) -> RowRule:
    return RowRule("not_null", col, F.col(col).isNull())


def max_length(col: str, n: int) -> RowRule:
    return RowRule("max_length", col, F.length(col) > n)


def fixed_length(col: str, lengths: Sequence[int]) -> RowRule:
    return RowRule("fixed_length", col, ~F.length(col).isin(list(lengths)))


def non_negative(col: str) -> RowRule:
    return RowRule("non_negative", col, F.col(col) < 0)


def constraint_audit(
    df: DataFrame,
    rules: Sequence[RowRule],
    unique: Sequence[str] = (),
    parents: Mapping[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """One row per rule with its number of violations.

    All row rules share one scan.  UNIQUE counts the rows beyond the first of a value;
    a foreign key counts rows whose value has no parent.  For both, the rows are first
    counted per value, so a value shared by many rows is one row in the shuffle.
    """
    reports = []
    if rules:
        counts = df.agg(*[F.count_if(r.broken).alias(f"v{i}") for i, r in enumerate(rules)])
        lines = [
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.column).alias("column_name"),
                F.col(f"v{i}").alias("violations"),
            )
            for i, r in enumerate(rules)
        ]
        reports.append(counts.select(F.inline(F.array(*lines))))

    def line(rule: str, col: str, counted: DataFrame, violations: Column) -> DataFrame:
        return counted.agg(F.coalesce(violations, F.lit(0)).alias("violations")).select(
            F.lit(rule).alias("rule"), F.lit(col).alias("column_name"), "violations"
        )

    for col in unique:
        reports.append(
            line("unique", col, _per_value(df, col), F.sum(F.col("n") - 1).cast("long"))
        )
    for col, (parent, parent_key) in (parents or {}).items():
        known = parent.select(F.col(parent_key).alias("value"))
        orphans = _per_value(df, col).join(known, "value", "left_anti")
        reports.append(line("foreign_key", col, orphans, F.sum("n")))
    return reduce(DataFrame.unionByName, reports)


def _per_value(df: DataFrame, col: str) -> DataFrame:
    value = F.col(col).alias("value")
    return df.filter(F.col(col).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))

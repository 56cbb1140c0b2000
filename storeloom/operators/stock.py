"""Supplies and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.clock import weeks_starting
from storeloom.functions.hot import HOT_ROWS
from storeloom.functions.ordered import running_count

# The stock inspection runs on Mondays at 08:00; weeks are counted from
# 1970-01-01, a Thursday, hence four days.
MONDAY_0800 = "4 days 8 hours"


def low_stock(items: DataFrame, on_hand: str, minimum: str) -> DataFrame:
    """Items strictly below their minimum, with the missing quantity."""
    return items.filter(F.col(on_hand) < F.col(minimum)).withColumn(
        "deficit", F.col(minimum) - F.col(on_hand)
    )


def purchase_report(
    low: DataFrame,
    supplier: str,
    item: str,
    bucket: Column,
    page_size: int = 1000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What to buy from whom: totals per supplier and the ordered list of items.

    The list comes in pages of ``page_size`` items, so that a supplier of very many
    items never has to fit in one row or one task.  ``bucket`` cuts the item order
    into ranges (see ``running_count``).
    """
    totals = low.groupBy(supplier).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("deficit").alias("to_buy")
    )
    placed = running_count(low, [supplier], bucket, [F.col(item)], "_place", hot_rows)
    page = F.floor((F.col("_place") - 1) / F.lit(page_size))
    pages = placed.groupBy(supplier, page.alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(item), F.col("deficit")))).alias("items")
    )
    return pages.join(totals, supplier)


def weekly_position(
    moves: DataFrame,
    item: str,
    ts: str,
    quantity: str,
    tz: str | None = None,
    offset: str = MONDAY_0800,
    until: Column | None = None,
) -> DataFrame:
    """Each item's stock at every weekly cut from its first movement on.

    A movement belongs to the week that ends at the next cut after it; one exactly on
    the cut opens the next week.  ``tz`` turns UTC into the shop's wall clock first.
    Weeks without movements are reported too, up to the item's last one or, if that is
    later, the week of ``until`` (an instant).  Movements without a time have no week and
    are left out.  The running sum sees one row per item and week, not the movements.
    """
    at = F.col(ts) if tz is None else F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts))
    weekly = moves.groupBy(item, weeks_starting(at, offset).alias("week_start")).agg(
        F.sum(quantity).alias("moved")
    )
    by_week = Window.partitionBy(item).orderBy("week_start")
    week = F.expr("INTERVAL 7 DAYS")
    after = F.lead("week_start").over(by_week)
    if until is not None:
        # The last week of an item is followed by quiet ones up to the one of ``until``.
        passed = F.floor(F.datediff(until, F.col("week_start")) / 7).cast("int")
        last = F.make_dt_interval(F.greatest(passed, F.lit(0)) * 7) + F.col("week_start")
        over = F.when(last > until, last).otherwise(last + week)
        after = F.coalesce(after, F.greatest(over, F.col("week_start") + week))
    # The running sum stays as it is in the quiet weeks up to the next one with movements.
    known = weekly.withColumns(
        {
            "position": F.sum("moved").over(by_week.rowsBetween(Window.unboundedPreceding, 0)),
            "_until": F.coalesce(after, F.col("week_start") + week) - week,
        }
    )
    weeks = F.sequence("week_start", "_until", week)
    return known.select(item, F.posexplode(weeks).alias("_quiet", "week_start"), "moved", "position").select(
        item,
        "week_start",
        F.when(F.col("_quiet") == 0, F.col("moved")).otherwise(F.lit(0)).alias("moved"),
        (F.col("week_start") + week).alias("cut_at"),
        "position",
    )


def apply_scans(
    catalog: DataFrame, scans: DataFrame, sku: str, on_hand: str, quantity: Column | None = None
) -> DataFrame:
    """Stock after barcode scans, one row per SKU on either side.

    Scans shrink to one row per SKU before the join.  Unknown SKUs and scans beyond
    the stock are flagged, not lost.
    """
    taken = scans.groupBy(sku).agg(
        F.sum(F.lit(1) if quantity is None else quantity).alias("scanned")
    )
    stock = catalog.select(sku, on_hand).withColumn("_known", F.lit(True))
    left = F.col(on_hand) - F.coalesce("scanned", F.lit(0))
    return stock.join(taken, sku, "full_outer").select(
        sku,
        on_hand,
        F.coalesce("scanned", F.lit(0)).alias("scanned"),
        left.alias("remaining"),
        F.col("_known").isNull().alias("unknown_sku"),
        F.coalesce(left < 0, F.lit(False)).alias("oversold"),
    )

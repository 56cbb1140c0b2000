"""Orders, customers and leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.hot import HOT_ROWS, hot_keys, mark_hot
from storeloom.functions.ordered import place_of

# The stages of the lead funnel, in order.
FUNNEL_STAGES = ("Frio", "Morno", "Quente", "Convertido")
OTHER = "other"
# Digits in a person's and in a company's document.
DOCUMENT_CLASSES = {11: "CPF", 14: "CNPJ"}


def customer_360(
    customers: DataFrame,
    orders: DataFrame,
    key: str,
    amount: str,
    created: str,
    status: str,
    statuses: Sequence[str],
) -> DataFrame:
    """Per customer: number of orders, spend, first and last order, orders per status.

    Orders are aggregated before the join, so it meets one row per customer;
    customers without orders stay, with zeros.
    """
    mix = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses]
    per_customer = orders.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(amount).alias("spend"),
        F.min(created).alias("first_order"),
        F.max(created).alias("last_order"),
        *mix,
    )
    zeros = ["n_orders", "spend", *[f"n_{s}" for s in statuses]]
    return customers.join(per_customer, key, "left").fillna(0, zeros)


def orders_by_status(
    orders: DataFrame, status: str, amount: str, statuses: Sequence[str] | None = None
) -> DataFrame:
    """Orders and their value per situation, for all situations or the named ones."""
    if statuses is not None:
        orders = orders.filter(F.col(status).isin(list(statuses)))
    return orders.groupBy(status).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(amount).alias("total")
    )


def transitions(
    events: DataFrame,
    key: str,
    status: str,
    order: Sequence[str],
    bucket: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """How often one status directly follows another for the same entity.

    The history of an entity with very many events is cut into buckets along ``order``
    (minutes, say), numbers that are null where the order is; events without a time come
    first.  Pairs inside a bucket come from ``lag``; the pairs across buckets
    from the first and last event of each bucket.
    """
    rows = events.filter(F.col(key).isNotNull()).select(key, status, *order, bucket.alias("_at"))
    by_order = [F.col(c) for c in order]
    whole = Window.partitionBy(key).orderBy(*by_order)
    hot = hot_keys(rows, [key], hot_rows)
    if hot is None:
        pairs = rows.select(F.lag(F.struct(status)).over(whole).alias("_p"), status)
        return _count_pairs(pairs, status)
    inside = Window.partitionBy(key, "_b").orderBy(*by_order)
    paired = (
        mark_hot(rows, hot)
        .withColumn("_b", F.when(F.col("_hot"), place_of(F.col("_at"))))
        .withColumns(
            {
                "_p": F.lag(F.struct(status)).over(inside),
                "_last": F.lead(F.lit(True)).over(inside).isNull(),
            }
        )
    )
    # Only hot entities have buckets; by the bucket Spark leaves out all others early.
    edges = paired.filter(F.col("_b").isNotNull() & (F.col("_p").isNull() | F.col("_last")))
    across = edges.withColumn("_before", F.lag(F.struct(status)).over(whole)).filter(
        F.col("_p").isNull()
    )
    pairs = paired.select("_p", status).unionByName(
        across.select(F.col("_before").alias("_p"), status)
    )
    return _count_pairs(pairs, status)


def _count_pairs(pairs: DataFrame, status: str) -> DataFrame:
    return (
        pairs.filter(F.col("_p").isNotNull())
        .groupBy(F.col(f"_p.{status}").alias("previous"), F.col(status).alias("current"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pending_recovery(
    pending: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    key: str,
    created: str,
    paid_at: str,
    contact: str,
) -> DataFrame:
    """Pending orders worth a reminder: reachable customer, no later payment.

    "No later payment" only needs the last payment of a customer, so payments shrink to
    one row per customer.  Contact and last payment meet first, both unique on the key;
    the orders then take part in a single join, where a busy customer can be split.
    """
    last_paid = payments.groupBy(key).agg(F.max(paid_at).alias("_last_paid"))
    reachable = (
        customers.filter(F.col(contact).isNotNull())
        .select(key, contact)
        .join(last_paid, key, "left")
    )
    later = F.coalesce(F.col("_last_paid") > F.col(created), F.lit(False))
    return pending.join(reachable, key).filter(~later).drop("_last_paid")


def shipping_notices(
    invoiced: DataFrame,
    customers: DataFrame,
    sent: DataFrame,
    order_key: str,
    customer_key: str,
    tracking: str,
    contact: str,
) -> DataFrame:
    """Invoiced orders with a tracking code whose customer has not been told yet."""
    reachable = customers.filter(F.col(contact).isNotNull()).select(customer_key, contact)
    return (
        invoiced.filter(F.col(tracking).isNotNull())
        .join(sent.select(order_key), order_key, "left_anti")
        .join(reachable, customer_key)
    )


def link_contacts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the right side's columns attached by external id, and ``linked``."""
    attached = right.withColumn("linked", F.lit(True))
    return left.join(attached, key, "left").fillna(False, ["linked"])


def unlinked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose external id is not on the right side."""
    return left.join(right.select(key), key, "left_anti")


def funnel(
    leads: DataFrame, stage: str, origin: str, stages: Sequence[str] = FUNNEL_STAGES
) -> DataFrame:
    """Leads per origin and stage, with the share of the origin's leads.

    Each origin reports every stage, in funnel order, also those without leads, and last,
    if it has any, its leads of no known stage as ``other``.
    """
    per_origin = leads.groupBy(origin).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col(stage) == s).alias(f"_s{i}") for i, s in enumerate(stages)],
        F.count_if(~F.coalesce(F.col(stage).isin(list(stages)), F.lit(False))).alias(
            f"_s{len(stages)}"
        ),
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(f"_s{i}").alias("n")
            )
            for i, s in enumerate([*stages, OTHER])
        ]
    )
    told = F.filter(lines, lambda x: (x["position"] < len(stages)) | (x["n"] > 0))
    return per_origin.select(origin, "_all", F.inline(told)).select(
        origin,
        "position",
        "stage",
        "n",
        F.round(F.col("n") / F.col("_all"), 6).alias("share"),
    )


def normalize_contacts(df: DataFrame, phone: str, document: str) -> DataFrame:
    """Digits-only phone and document, and the class of document by its length."""

    def digits(col: str) -> Column:
        return F.nullif(F.regexp_replace(col, "[^0-9]", ""), F.lit(""))

    clean = df.withColumns({phone: digits(phone), document: digits(document)})
    kind = F.lit("invalid")
    for length, name in DOCUMENT_CLASSES.items():
        kind = F.when(F.length(document) == length, name).otherwise(kind)
    return clean.withColumn("document_class", F.when(F.col(document).isNotNull(), kind))


def converted_leads(leads: DataFrame, customers: DataFrame, document: str) -> DataFrame:
    """Leads whose document belongs to a customer."""
    return leads.join(customers.select(document), document, "left_semi")


def open_leads(leads: DataFrame, customers: DataFrame, document: str) -> DataFrame:
    """Leads whose document belongs to no customer (or is missing)."""
    return leads.join(customers.select(document), document, "left_anti")


def lead_conversion(leads: DataFrame, customers: DataFrame, document: str) -> DataFrame:
    """All leads with a ``converted`` flag, in one join."""
    known = customers.select(document).distinct().withColumn("converted", F.lit(True))
    return leads.join(known, document, "left").fillna(False, ["converted"])

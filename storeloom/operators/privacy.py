"""Opt-out, erasure and clean-up of personal data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The refusal words customers send.
OPTOUT_WORDS = ("Parar", "Sair", "Cancelar")
# Fixed value: days without activity after which a lead is scrubbed.
INACTIVE_DAYS = 30

# Enough of an address or number to tell that one is there: a text is searched for the
# "@" with one character before it, not for every run of characters that might lead to one.
EMAIL = r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"[0-9][0-9 ().-]{7,}[0-9]"


def refusal(text: Column, words: Sequence[str] = OPTOUT_WORDS, mode: str = "message") -> Column:
    """True for a refusal: the whole message, or with ``first_token`` its first word,
    is one of ``words``, whatever the case and the punctuation around it."""
    plain = F.lower(text)
    plain = F.regexp_replace(plain, r"^[^\p{L}\p{N}]+", "")
    if mode == "first_token":
        plain = F.regexp_extract(plain, r"^[\p{L}\p{N}]+", 0)
    elif mode == "message":
        plain = F.regexp_replace(plain, r"[^\p{L}\p{N}]+$", "")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(plain.isin([w.lower() for w in words]), F.lit(False))


def optouts(
    messages: DataFrame,
    person: str,
    text: str,
    ts: str,
    words: Sequence[str] = OPTOUT_WORDS,
    mode: str = "message",
) -> DataFrame:
    """People who refused further messages and when they first did."""
    return (
        messages.filter(refusal(F.col(text), words, mode))
        .groupBy(person)
        .agg(F.min(ts).alias("first_refusal"), F.count(F.lit(1)).alias("n_refusals"))
    )


def erase(
    df: DataFrame, people: DataFrame, key: str, pii_cols: Sequence[str]
) -> DataFrame:
    """Null the personal columns of the listed people; all rows and the schema stay.

    The list has one row per person after ``distinct``; a person with very many rows is
    split by Spark's skew handling, as only the other side is unique.
    """
    listed = people.select(key).distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, key, "left").select(
        *[
            F.when(F.col("_listed").isNull(), F.col(c)).alias(c) if c in pii_cols else F.col(c)
            for c in df.columns
        ]
    )


def scrub_inactive(
    leads: DataFrame,
    activity: DataFrame,
    key: str,
    captured: str,
    active_at: str,
    as_of: Column,
    pii_cols: Sequence[str],
    days: int = INACTIVE_DAYS,
) -> DataFrame:
    """Null the personal columns of leads idle for more than ``days``.

    A lead's last activity is the later of its capture and its last event; events are
    reduced to one row per lead before the join.
    """
    last = activity.groupBy(key).agg(F.max(active_at).alias("_last"))
    idle = F.greatest(F.col("_last"), F.col(captured)) < as_of - F.expr(f"INTERVAL {days} DAYS")
    flagged = leads.join(last, key, "left").withColumn("inactive", F.coalesce(idle, F.lit(False)))
    return flagged.select(
        *[
            F.when(~F.col("inactive"), F.col(c)).alias(c) if c in pii_cols else F.col(c)
            for c in leads.columns
        ],
        "inactive",
    )


def pii_residue(
    df: DataFrame,
    should_be_empty: Column | None = None,
    pii_cols: Sequence[str] = (),
    text_cols: Sequence[str] = (),
    patterns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Audit, in one scan: erased rows that still carry values, and PII in free text."""
    patterns = patterns or {"email": EMAIL, "phone": PHONE}
    checks = [
        ("not_erased", c, F.count_if(should_be_empty & F.col(c).isNotNull())) for c in pii_cols
    ] + [
        (f"{name}_in_text", c, F.count_if(F.col(c).rlike(pattern)))
        for c in text_cols
        for name, pattern in patterns.items()
    ]
    counts = df.agg(*[count.alias(f"n{i}") for i, (_, _, count) in enumerate(checks)])
    lines = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.lit(col).alias("column_name"),
            F.col(f"n{i}").alias("n_rows"),
        )
        for i, (name, col, _) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*lines)))

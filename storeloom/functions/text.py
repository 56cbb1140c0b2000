"""Column expressions on identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture(text: Column, pattern: str) -> Column:
    """Group 1 of the pattern's first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def first_capture(text: Column, patterns: Sequence[str], default: Column) -> Column:
    """Group 1 of the first pattern that matches, tried in order."""
    return F.coalesce(*[capture(text, p) for p in patterns], default)


def strip_all(text: Column, patterns: Sequence[str]) -> Column:
    """Remove the patterns, one after the other."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def some_contains(items: Column, needle: str) -> Column:
    """True if an element of the list contains ``needle`` as a substring."""
    return F.coalesce(F.exists(items, lambda x: x.contains(needle)), F.lit(False))


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    wrapped = F.to_json(F.array(text))
    return F.substr(wrapped, F.lit(2), F.length(wrapped) - 2)

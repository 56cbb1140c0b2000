"""Versioned catalogues: filter, derive, reduce to the current entries, publish."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.functions.text import any_match, first_capture, json_string, some_contains, strip_all
from storeloom.operators.dedup import first_by_key


def filter_catalog(
    df: DataFrame,
    row_id: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    owner: str | None = None,
    not_owners: Sequence[str] = (),
    needs: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keep entries whose id matches one of ``include`` and none of ``exclude``, whose
    owner is not barred and whose capability lists hold what is needed (an element
    containing the text is enough)."""
    keep = F.lit(True)
    if include:
        keep = keep & any_match(F.col(row_id), include)
    if exclude:
        keep = keep & ~any_match(F.col(row_id), exclude)
    if not_owners:
        keep = keep & ~F.coalesce(F.col(owner).isin(list(not_owners)), F.lit(False))
    for col, needle in (needs or {}).items():
        keep = keep & some_contains(F.col(col), needle)
    return df.filter(keep)


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Category of the first (pattern, category) rule that matches; order matters."""
    out = None
    for pattern, category in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.lit(default) if out is None else out.otherwise(default)


def canonical(text: Column, suffixes: Sequence[str]) -> Column:
    """The id without its date, preview or alias decoration."""
    return strip_all(text, suffixes)


def derive_line(text: Column, patterns: Sequence[str], default: Column) -> Column:
    """Product line (or tier, or version prefix) of an id: the first pattern's capture."""
    return first_capture(text, patterns, default)


def numeric_version(text: Column, patterns: Sequence[str], default: float = 1.0) -> Column:
    """Version number of an id by the first pattern that matches."""
    return first_capture(text, patterns, F.lit(str(default))).cast("double")


def pick_preferred(df: DataFrame, key: str, prefer: str, pos: str) -> DataFrame:
    """One entry per key: a preferred one (alias, stable) first, then in source order."""
    ranked = df.withColumn("_late", ~F.coalesce(F.col(prefer), F.lit(False)))
    return first_by_key(ranked, [key], ["_late", pos]).drop("_late")


def latest_line(
    df: DataFrame, line: str, version: str, created: str, tie: str
) -> DataFrame:
    """Per product line all entries that share the version of its newest entry.

    The newest version of a line is found by a combined aggregation and joined back, so
    a line with most of the entries is never one task.
    """
    newest = df.groupBy(F.col(line).alias("_line")).agg(
        F.max_by(F.struct(version), F.struct(created, tie)).alias("_version")
    )
    return _same_version(df, newest, line, version)


def latest_numeric(df: DataFrame, tier: str, version: str) -> DataFrame:
    """Per tier all entries with its highest version."""
    newest = df.groupBy(F.col(tier).alias("_line")).agg(
        F.struct(F.max(version).alias(version)).alias("_version")
    )
    return _same_version(df, newest, tier, version)


def _same_version(df: DataFrame, newest: DataFrame, line: str, version: str) -> DataFrame:
    same = F.col(line).eqNullSafe(F.col("_line")) & F.col(version).eqNullSafe(
        F.col(f"_version.{version}")
    )
    return df.join(newest, same, "left_semi")


def tags(
    rules: Sequence[tuple[Column | bool, Sequence[str]]],
    lists: Sequence[Column] = (),
    drop: Sequence[str] = (),
) -> Column:
    """Sorted set of the tags whose condition holds and of the listed arrays, as text."""
    flagged = [
        F.when(F.lit(True) if when is True else when, F.lit(tag))
        for when, names in rules
        for tag in names
    ]
    none = F.array().cast("array<string>")
    together = F.concat(F.array(*flagged), *[F.coalesce(one, none) for one in lists])
    kept = F.filter(
        F.array_distinct(F.array_compact(together)), lambda t: ~t.isin(list(drop))
    )
    return F.array_join(F.array_sort(kept), ", ")


def free_tier(
    prompt: Column | None = None, completion: Column | None = None, name: Column | None = None,
    patterns: Sequence[str] = (),
) -> Column:
    """Free of charge: both prices are the text "0", or the name says so."""
    free = F.lit(False)
    if prompt is not None:
        free = free | F.coalesce((prompt == "0") & (completion == "0"), F.lit(False))
    if name is not None:
        free = free | F.coalesce(any_match(name, patterns), F.lit(False))
    return free


def unify(sources: Sequence[DataFrame]) -> DataFrame:
    """Append the sources' entries in one schema; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


@dataclass(frozen=True)
class Source:
    """A source in the router's order of priority.

    ``picks`` are id patterns tried in order; ``newest`` takes the newest entry of a
    pattern instead of the one listed first.  Without a match the entry listed first
    stands in.
    """

    name: str
    picks: tuple[str, ...] = ()
    newest: bool = False
    prefix: str | None = None


def route(
    df: DataFrame,
    row_id: str,
    source: str,
    created: str,
    listed: Sequence[str],
    sources: Sequence[Source],
    default: str,
    shown: Column | None = None,
) -> DataFrame:
    """The one entry to send requests to, or the default.

    The first source that has entries decides.  ``listed`` is the listing order as
    columns, the entry listed first having the highest values; ``shown`` is what the
    target names an entry by, its id unless given.  Everything is a
    combined aggregation: one row per source and pattern, then one row.
    """
    rank, pick, newest, prefix = (F.lit(None) for _ in range(4))
    for i, s in reversed(list(enumerate(sources))):
        mine = F.col(source) == s.name
        which = F.lit(len(s.picks))
        for j, pattern in reversed(list(enumerate(s.picks))):
            which = F.when(F.col(row_id).rlike(pattern), j).otherwise(which)
        rank = F.when(mine, i).otherwise(rank)
        pick = F.when(mine, which).otherwise(pick)
        newest = F.when(mine, F.lit(s.newest) & (which < len(s.picks))).otherwise(newest)
        prefix = F.when(mine, F.lit(s.prefix or s.name)).otherwise(prefix)
    place = F.struct(*listed)
    candidates = df.select(
        rank.alias("_rank"),
        pick.alias("_pick"),
        newest.alias("_newest"),
        F.concat_ws("/", prefix, F.col(row_id) if shown is None else shown).alias("_target"),
        (-F.col(created)).alias("_age"),
        place.alias("_place"),
    ).filter(F.col("_rank").isNotNull())
    per_pick = candidates.groupBy("_rank", "_pick").agg(
        F.first("_newest").alias("_newest"),
        F.max_by("_target", F.struct("_place")).alias("_listed_first"),
        # An entry without a date is older than any with one.
        F.min_by("_target", F.struct(F.col("_age").isNull(), "_age", "_place")).alias(
            "_created_last"
        ),
    )
    choice = F.when(F.col("_newest"), F.col("_created_last")).otherwise(F.col("_listed_first"))
    best = per_pick.agg(F.min_by(choice, F.struct("_rank", "_pick")).alias("_best"))
    return best.select(F.coalesce("_best", F.lit(default)).alias("target"))


def publish_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries added, removed or changed between two states; empty when equal."""
    values = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_in_old"))
    after = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return (
        before.join(after, list(keys), "full_outer")
        .select(*keys, change.alias("change"))
        .filter(F.col("change").isNotNull())
    )


def publish_if_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str) -> bool:
    """Write ``new`` to ``path`` only if it differs; ``path`` must not be read by ``old``."""
    if publish_diff(old, new, keys).isEmpty():
        return False
    new.write.mode("overwrite").parquet(path)
    return True


def purge(
    df: DataFrame, failures: DataFrame, row_id: str, failed_id: str, message: str, needle: str
) -> DataFrame:
    """Entries no failure report marks as gone; reports shrink to one row per entry."""
    gone = (
        failures.filter(F.col(message).contains(needle))
        .select(F.col(failed_id).alias(row_id))
        .distinct()
    )
    return df.join(gone, row_id, "left_anti")


def listing(df: DataFrame, source: str, created: str, tie: Sequence[str]) -> DataFrame:
    """Newest first within each source, ties the other way round too."""
    return df.orderBy(F.asc(source), F.desc(created), *[F.desc(t) for t in tie])


# How an entry is shown and tagged.
FREE_MARK = "🟢 FREE: "
FREE_PREFIX = "FREE-"
FREE_TAG = "grátis"
PAID_TAG = "pago"
ROUTE_NAMES = {"google": "gemini"}


def render(
    df: DataFrame, row_id: str, provider: str, category: str, description: str, free: str
) -> DataFrame:
    """Published form of each entry: prefixed name, route, display name, tags."""
    route_name = F.col(provider)
    for name, shown in ROUTE_NAMES.items():
        route_name = F.when(F.col(provider) == name, shown).otherwise(route_name)
    is_free = F.coalesce(F.col(free), F.lit(False))
    ident = F.col(row_id)
    name_tags = F.array_append(
        F.split(F.col(category), ", "), F.when(is_free, FREE_TAG).otherwise(PAID_TAG)
    )
    return df.select(
        ident.alias("id"),
        F.concat(
            route_name, F.lit("/"), F.when(is_free, FREE_PREFIX).otherwise(""), ident
        ).alias("model_name"),
        F.concat(route_name, F.lit("/"), ident).alias("model"),
        json_string(F.when(is_free, F.concat(F.lit(FREE_MARK), ident)).otherwise(ident)).alias(
            "name"
        ),
        json_string(F.col(description)).alias("description"),
        F.to_json(name_tags).alias("tags"),
    )

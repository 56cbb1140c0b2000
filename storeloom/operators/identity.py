"""Who is the same person: identifiers linked by the rows that carry several of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.session import work_folder


@dataclass(frozen=True)
class Personal:
    """A table with people in it: its identifiers by kind, and its personal columns.

    Identifiers of one kind are comparable across tables (a document, a phone number, a
    contact id); the columns may be normalised on the way.
    """

    rows: DataFrame
    identifiers: Mapping[str, Column]
    personal: Sequence[str]


def _named(identifiers: Mapping[str, Column]) -> list[Column]:
    """Kind and value of each identifier as one string, null where there is none."""
    return [F.concat(F.lit(f"{kind}:"), value.cast("string")) for kind, value in identifiers.items()]


def links(tables: Sequence[Personal]) -> DataFrame:
    """Pairs of different identifiers of one row, the smallest of the row with each other."""
    pairs = []
    for t in tables:
        found = F.array_sort(F.array_distinct(F.array_compact(F.array(*_named(t.identifiers)))))
        ids = t.rows.select(found.alias("_ids")).filter(F.size("_ids") > 1)
        rest = F.explode(F.slice("_ids", 2, F.size("_ids")))
        pairs.append(ids.select(F.element_at("_ids", 1).alias("a"), rest.alias("b")))
    return reduce(DataFrame.unionByName, pairs).distinct()


def _written(df: DataFrame, label: str) -> DataFrame:
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(pairs: DataFrame) -> DataFrame:
    """For every node of ``pairs`` (``a``, ``b``) the least node it is linked to: ``node``, ``root``.

    Alternates two steps until nothing changes: every node hands its larger neighbours to
    its least one, then its smaller ones.  Both halve chains, so a chain of n links takes
    about log n rounds.  A hub's neighbours are never together in one row: each of them
    meets the hub's least neighbour by a join whose other side is unique, which Spark can
    split.  Every round is written down.
    """
    edges = _written(
        pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = _written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def everywhere(tables: Sequence[Personal], people: DataFrame, kind: str, column: str) -> DataFrame:
    """All identifiers of the listed people: those given, and all linked to them, as ``id``."""
    seeds = people.select(F.concat(F.lit(f"{kind}:"), F.col(column).cast("string")).alias("id"))
    seeds = seeds.filter("id IS NOT NULL").distinct()
    linked = _written(components(links(tables)), "identities")
    roots = linked.join(seeds, F.col("node") == F.col("id"), "left_semi").select("root").distinct()
    others = linked.join(roots, "root", "left_semi").select(F.col("node").alias("id"))
    return seeds.union(others).distinct()


def erase_everywhere(
    tables: Mapping[str, Personal], people: DataFrame, kind: str, column: str
) -> dict[str, DataFrame]:
    """Null the personal columns of the listed people in all tables; rows and schemas stay.

    A row is theirs if one of its identifiers is, directly or over any chain of rows that
    share a document, a phone number or another identifier.  Identifiers that are null link
    nothing; rows without any stay as they are.  The erased identifiers are unique on their
    side of every join.
    """
    gone = _written(everywhere(list(tables.values()), people, kind, column), "erased")
    out = {}
    for name, t in tables.items():
        rows = t.rows
        flags = []
        for i, own in enumerate(_named(t.identifiers)):
            rows = rows.withColumn(f"_id{i}", own)
            listed = gone.select(F.col("id").alias(f"_id{i}"), F.lit(True).alias(f"_gone{i}"))
            rows = rows.join(listed, f"_id{i}", "left")
            flags.append(F.coalesce(f"_gone{i}", F.lit(False)))
        theirs = reduce(lambda a, b: a | b, flags)
        out[name] = rows.select(
            *[F.when(~theirs, F.col(c)).alias(c) if c in t.personal else F.col(c) for c in t.rows.columns]
        )
    return out

"""What differs between two copies of a table, found by a tree of checksums over key ranges.

A leaf covers a range of keys, a node above it 2^FAN_BITS neighbouring ranges.  The sums of
the rows' hashes do not depend on their order and add up, so a tree is one aggregation of its
table and a few of itself.  Two trees are compared from the top; only below nodes that differ
is the next level looked at, and only the rows of leaves that differ are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.session import work_folder

# A leaf covers 2^LEAF_BITS keys, each level above it 2^FAN_BITS times as many.
LEAF_BITS, FAN_BITS, LEVELS = 12, 8, 5
# A hash in three parts, so that the sums of a table of 2^41 rows still fit in a long.
PARTS = ["h0", "h1", "h2"]
SUMS = ["n", *PARTS]
_TREE = "node long, n long, h0 long, h1 long, h2 long, level int"


def leaf_of(key: Column, leaf_bits: int = LEAF_BITS) -> Column:
    """The range a key lies in; keys that are null have one of their own."""
    return F.shiftright(key.cast("long"), leaf_bits)


def _hashes(df: DataFrame) -> list[Column]:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    low = F.lit((1 << 21) - 1)
    return [
        row.bitwiseAND(low),
        F.shiftrightunsigned(row, 21).bitwiseAND(low),
        F.shiftrightunsigned(row, 42),
    ]


def _summed(grouped) -> DataFrame:
    return grouped.agg(*[F.sum(c).alias(c) for c in SUMS])


def checksum_tree(df: DataFrame, key: str, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """(node, n, h0, h1, h2, level) of all levels, the leaves being level 0.

    The table is read once, its rows added up map-side; each level is a sum over the one
    below.
    """
    rows = df.select(
        leaf_of(F.col(f"`{key}`"), leaf_bits).alias("node"),
        F.lit(1).cast("long").alias("n"),
        *[h.alias(c) for h, c in zip(_hashes(df), PARTS)],
    )
    levels = [_summed(rows.groupBy("node"))]
    for _ in range(LEVELS - 1):
        below = levels[-1].withColumn("node", F.shiftright("node", FAN_BITS))
        levels.append(_summed(below.groupBy("node")))
    return reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(i)) for i, t in enumerate(levels)])


def write_tree(df: DataFrame, key: str, path: str, leaf_bits: int = LEAF_BITS) -> None:
    """Keep the tree beside its table; levels are folders, so a look at one reads no other."""
    checksum_tree(df, key, leaf_bits).write.mode("overwrite").partitionBy("level").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_TREE).parquet(path)


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """The leaves (``leaf``) of two trees that do not agree, by descending from the top."""
    known = None
    for level in reversed(range(LEVELS)):
        # Equal nodes of both trees add up to nothing.
        ours = a.filter(F.col("level") == level).select("node", *SUMS)
        theirs = b.filter(F.col("level") == level).select("node", *[(-F.col(c)).alias(c) for c in SUMS])
        nodes = ours.unionByName(theirs)
        if known is not None:
            above = F.shiftright("node", FAN_BITS).eqNullSafe(F.col("_above"))
            nodes = nodes.join(known.withColumnRenamed("node", "_above"), above, "left_semi")
        unequal = reduce(lambda x, y: x | y, [F.col(c) != 0 for c in SUMS])
        known = _summed(nodes.groupBy("node")).filter(unequal).select("node")
    return known.withColumnRenamed("node", "leaf")


def differing_rows(
    source: DataFrame,
    copy: DataFrame,
    key: str,
    trees: tuple[DataFrame, DataFrame] | None = None,
    leaf_bits: int = LEAF_BITS,
) -> DataFrame:
    """The keys whose rows differ: ``key``, ``change``, rows in the source and in the copy.

    ``change`` is ``lost`` where the copy has none, ``added`` where only the copy has some,
    else ``changed``.  Rows that share a key, or have none, are compared together, in
    number and content.  Without ``trees`` both are made here; they and the leaves found are
    written down, so that no level is added up again for the next one.
    """
    spark, folder = source.sparkSession, work_folder(source.sparkSession, "checksum-trees")
    if trees is None:
        for name, df in (("source", source), ("copy", copy)):
            write_tree(df, key, f"{folder}/{name}", leaf_bits)
        trees = tuple(read_tree(spark, f"{folder}/{name}") for name in ("source", "copy"))
    differing_leaves(*trees).write.parquet(f"{folder}/leaves")
    leaves = spark.read.schema("leaf long").parquet(f"{folder}/leaves")
    sides = []
    for df, side in ((source, 0), (copy, 1)):
        rows = df.select(
            F.col(f"`{key}`").alias("key"),
            leaf_of(F.col(f"`{key}`"), leaf_bits).alias("_leaf"),
            F.lit(1 - side).cast("long").alias("n_source"),
            F.lit(side).cast("long").alias("n_copy"),
            # Equal rows on both sides add up to nothing.
            *[(h if side else -h).alias(c) for h, c in zip(_hashes(df), PARTS)],
        )
        sides.append(rows.join(leaves, F.col("_leaf").eqNullSafe(F.col("leaf")), "left_semi"))
    change = F.when(F.col("n_copy") == 0, "lost").when(F.col("n_source") == 0, "added").otherwise("changed")
    equal = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in PARTS], F.col("n_source") == F.col("n_copy"))
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy("key")
        .agg(*[F.sum(c).alias(c) for c in ("n_source", "n_copy", *PARTS)])
        .filter(~equal)
        .select("key", change.alias("change"), "n_source", "n_copy")
    )

"""From raw documents to token ids: five stages, each applied to all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads
it.  All but the last give back the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.llm import bpe
from storeloom.llm.common import saved, table
from storeloom.llm.line_dedup import line_dedup
from storeloom.llm.mixing import take_mixed
from storeloom.llm.quality_forest import quality_rules
from storeloom.llm.queries import vocabulary
from storeloom.llm.simhash import near_duplicates
from storeloom.plans.registry import Query

# SQL can express neither the forest nor the classifier; tests compare with plain versions.
ORACLE_SQL = None


class Packed:
    """Documents as id, text and one struct of all other columns, whatever these are called."""

    def __init__(self, docs: DataFrame) -> None:
        self.columns = docs.columns
        self.rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.rest)]
        self.rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("columns"))

    def unpacked(self, df: DataFrame, **changed: Column) -> DataFrame:
        """The documents' own columns again, those in ``changed`` anew."""
        own = {c: F.col(f"columns.c{i}") for i, c in enumerate(self.rest)}
        own |= {c: F.col(c) for c in ("doc_id", "text")} | changed
        return df.select(*[own[c].alias(c) for c in self.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the forest let pass, unchanged."""
    packed = Packed(docs)
    judged = quality_rules(packed.rows, table(spark, sf_dir, "labels"))
    return packed.unpacked(judged.filter("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first; ``n_chars`` follows the text.

    Other columns stay as they are.
    """
    packed = Packed(docs)
    counted = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return packed.unpacked(line_dedup(packed.rows), **counted)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document: that with the smallest id.

    Rows that share an id, or have none, are documents of their own: among those with the
    smallest id the one whose text has the smallest MD5 stays, of identical ones one; rows
    without an id count as the largest.
    """
    ids = docs.select("doc_id").groupBy("doc_id").count()
    if not ids.filter("count > 1 OR doc_id IS NULL").limit(1).count():
        groups = near_duplicates(docs)
        kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(kept, "doc_id", "left_semi")
    packed = Packed(docs)
    name = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = saved(
        packed.rows.withColumn("name", name)
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), "name")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "name")
        .withColumn("row", F.monotonically_increasing_id()),
        "pipeline-rows",
    )
    groups = near_duplicates(numbered, id_col="row")
    kept = groups.filter(F.col("row") == F.col("component_id")).select("row")
    return packed.unpacked(numbered.join(kept, "row", "left_semi"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that mixing to the target weights takes at least once, unchanged."""
    return take_mixed(docs, table(spark, sf_dir, "labels"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the decoded bytes."""
    ranks = bpe.read_ranks(vocabulary())
    return bpe.token_digests(bpe.round_trip(docs, ranks), keep_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("soft_mixing", mixing_stage),
    ("byte_bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = Query(run, ORACLE_SQL)

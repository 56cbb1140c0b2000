"""Lines that many documents share are kept in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.llm.common import HIGHEST, SPACES, Folded, ascii_lower, body, saved


def line_key(line: Column) -> Column:
    """What lines are compared by: white space stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """The rows of ``docs`` with the text that is left, ``n_lines`` and ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and stands in at least
    ``min_docs`` documents is dropped everywhere but in the document with the smallest
    id; lines repeated inside one document do not count.  The other lines stay in order.

    A null text is an empty one, which is one empty line.  All rows without an id count as
    one document that comes after all others; so do rows that share an id, each of which
    keeps its own lines.  An input column called like an added one is replaced.

    Only hashes are shuffled until the last step: distinct (key, document) pairs are
    counted per key with map-side sums, so a line that a third of all documents hold is a
    few partial counts.  The keys over the threshold are written down, which leaves both
    sides of the join with the lines plain exchanges that Spark can split where a key is
    hot.  The text itself moves once, to meet the positions to drop.
    """
    folded = Folded(docs, text_col, ["n_lines", "n_dropped"])
    rows = folded.rows.withColumns(
        {
            "_doc": F.coalesce(F.col(f"_rest.`{id_col}`").cast("long"), F.lit(HIGHEST)),
            "_text": body("_text"),
        }
    ).withColumn("_row", F.unhex(F.md5("_text")))
    lines = (
        rows.select("_doc", "_row", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .select("_doc", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.length("_key") >= min_chars)
        .withColumn("_key", F.unhex(F.md5("_key")))
    )
    shared = saved(
        lines.select("_key", "_doc")
        .distinct()
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_docs"), F.min("_doc").alias("_first"))
        .filter(F.col("_docs") >= min_docs)
        .select("_key", "_first"),
        "line-keys",
    )
    drops = (
        lines.join(shared, "_key")
        .filter(F.col("_doc") != F.col("_first"))
        .groupBy("_doc", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    split = rows.join(drops, ["_doc", "_row"], "left").withColumn("_lines", F.split("_text", "\n"))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    left = F.array_except(places, F.col("_drop"))
    kept = F.array_join(F.transform(left, lambda i: F.col("_lines")[i]), "\n")
    return folded.unfolded(
        split.withColumns(
            {
                "_text": F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept),
                "n_lines": F.size("_lines").cast("long"),
                "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
            }
        )
    )

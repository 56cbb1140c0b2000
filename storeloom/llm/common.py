"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.session import work_folder

# The white space and the capitals that the contracts name.
SPACES = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LOWEST, HIGHEST = -(2**63), 2**63 - 1


def body(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, CAPITALS, CAPITALS.lower())


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again.

    Cuts the lineage: a lost executor costs no recomputation of what is behind, and the
    driver's plan stays short.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Folded:
    """A table as two columns, ``_rest`` and ``_text``, so that no name of its own can clash.

    ``unfolded`` gives its columns back in their order, but for those called like a new one,
    with the new ones behind.
    """

    def __init__(self, docs: DataFrame, text_col: str, new: Sequence[str]) -> None:
        taken = {n.lower() for n in new}
        self.text_col, self.new = text_col, list(new)
        self.columns = [c for c in docs.columns if c.lower() not in taken]
        rest = [F.col(f"`{c}`") for c in self.columns if c != text_col]
        self.rows = docs.select(F.struct(*rest).alias("_rest"), F.col(f"`{text_col}`").alias("_text"))

    def unfolded(self, df: DataFrame) -> DataFrame:
        own = [
            F.col("_text").alias(c) if c == self.text_col else F.col(f"_rest.`{c}`").alias(c)
            for c in self.columns
        ]
        return df.select(*own, *self.new)

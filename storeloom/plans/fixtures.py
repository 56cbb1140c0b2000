"""The driver's tables: declared schemas and the shop roles they play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.sources.tables import read_tables

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

MONEY = {
    "customer": ["c_acctbal"],
    "supplier": ["s_acctbal"],
    "part": ["p_retailprice"],
    "orders": ["o_totalprice"],
    "lineitem": ["l_extendedprice"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_tables(spark, sf_dir, [name], TABLES, MONEY)[name]


def some_without(df: DataFrame, col: str, row_id: str) -> DataFrame:
    """The whole table with nulls in ``col`` of every tenth row."""
    return df.withColumn(col, F.when(F.col(row_id) % 10 > 0, F.col(col)))


def with_strangers(df: DataFrame, key: str) -> DataFrame:
    """The whole table, and once more under keys that no other table knows."""
    return df.unionByName(df.withColumn(key, -F.col(key) - 1))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def contact() -> Column:
    """A customer's contact; those in debt left none."""
    return F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("contact")

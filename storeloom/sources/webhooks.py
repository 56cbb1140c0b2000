"""Webhook deliveries arriving as files in a drop folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The actions a shop can subscribe to.
TOPICS = ("pedido.criado", "pedido.editado", "produto.editado")

ENVELOPE = "event_id STRING, topic STRING, ts STRING, body STRING"


def webhook_stream(
    spark: SparkSession, folder: str, envelope: str = ENVELOPE, files_per_trigger: int = 100
) -> DataFrame:
    """Stream of JSON deliveries; each file may hold many lines.

    ``ts`` becomes a timestamp, fit for a watermark.
    """
    raw = (
        spark.readStream.schema(envelope)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )
    return raw.withColumn("ts", F.try_to_timestamp("ts"))


def table_stream(spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream over the parquet files at ``path`` (a folder, or a glob of files)."""
    return (
        spark.readStream.schema(ddl)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def typed(deliveries: DataFrame, topic: str, body_ddl: str) -> DataFrame:
    """Deliveries of one topic with their body parsed; broken bodies give null fields."""
    parsed = deliveries.filter(F.col("topic") == topic).withColumn(
        "_body", F.from_json("body", body_ddl)
    )
    others = [c for c in deliveries.columns if c != "body"]
    return parsed.select(*others, "_body.*")

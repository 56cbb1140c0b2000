"""From a delivered webhook to the replica: two dedup stages, then the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storeloom.operators.dedup import dedup_hash, dedup_ttl, first_by_key
from storeloom.streaming.ttl_state import TtlStream

# Fixed value: seconds for which a payload's hash is remembered.
HASH_TTL_SECONDS = 300


def _hashed(deliveries: DataFrame, app_key: str, body: str) -> DataFrame:
    return deliveries.withColumn("dedup_hash", dedup_hash(F.col(body), F.lit(app_key)))


def accepted(
    deliveries: DataFrame, app_key: str, event_id: str, ts: str, body: str
) -> DataFrame:
    """Deliveries to act on: no repeat of a payload within the TTL, and of what is left
    the first with its event id."""
    hashed = _hashed(deliveries, app_key, body)
    fresh = dedup_ttl(hashed, "dedup_hash", ts, event_id, HASH_TTL_SECONDS)
    return first_by_key(fresh, [event_id], [ts])


class InboundStream:
    """``accepted`` on a stream whose deliveries come in time order.

    A batch's fresh payloads are compared with the event ids accepted by the batches before
    it, read from the accepted rows themselves and only for the ids at hand; there is no
    other state than these and the anchors.  ``late`` has the deliveries that came too late.
    """

    def __init__(
        self, deliveries: DataFrame, root: str, app_key: str, event_id: str, ts: str, body: str
    ) -> None:
        self.root, self.event_id, self.ts = root, event_id, ts
        self.hashed = _hashed(deliveries, app_key, body)
        self.fresh = TtlStream(
            f"{root}/fresh", self.hashed.schema, "dedup_hash", ts, event_id, HASH_TTL_SECONDS
        )

    def step(self, batch: DataFrame, batch_id: int) -> None:
        fresh = self.fresh.step(batch, batch_id)
        firsts = first_by_key(fresh, [self.event_id], [self.ts])
        if batch_id:
            before = self.accepted(batch.sparkSession).filter(F.col("batch_id") < batch_id)
            ids = firsts.select(self.event_id).distinct()
            seen = before.select(self.event_id).join(ids, self.event_id, "left_semi").distinct()
            firsts = firsts.join(seen, self.event_id, "left_anti")
        firsts.write.mode("overwrite").parquet(f"{self.root}/accepted/batch_id={batch_id}")

    def accepted(self, spark: SparkSession) -> DataFrame:
        with_batch = T.StructType([*self.hashed.schema.fields, T.StructField("batch_id", T.LongType())])
        return spark.read.schema(with_batch).parquet(f"{self.root}/accepted")

    def late(self, spark: SparkSession) -> DataFrame:
        return self.fresh.late(spark)

    def start(self, **trigger) -> StreamingQuery:
        return (
            self.hashed.writeStream.foreachBatch(self.step)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

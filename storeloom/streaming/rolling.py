"""Trailing request counts of a stream, with the last window of requests in a table by batch id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storeloom.functions.clock import micros
from storeloom.functions.hot import HOT_ROWS
from storeloom.operators.rates import rate_rolling


@dataclass(frozen=True)
class RollingStream:
    """``rate_rolling`` on a stream whose micro-batches come in time order.

    A batch is counted together with the requests of the last window before it, which are all
    that the stream remembers: their keys and times, in a folder named by the batch that
    wrote them.  So the state has the size of one window whatever the stream has seen, hot
    keys are cut into slices as in the batch form, and a repeated batch finds what it found
    before and replaces its own folders.

    Requests older than the newest one of the batches before are late: what was reported can
    no longer change, so they are written to ``late`` and counted nowhere.  Requests without
    a time stay, uncounted.  An instant must not be split over two batches.
    """

    root: str
    schema: T.StructType
    ts: str
    width_seconds: int
    limit: int
    key: str | None = None
    hot_rows: int = HOT_ROWS

    @property
    def _kept(self) -> T.StructType:
        names = [self.ts] if self.key is None else [self.key, self.ts]
        return T.StructType([self.schema[n] for n in names])

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch_id={batch_id}"

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = self._kept.names
        tail, newest = spark.createDataFrame([], self._kept), None
        if batch_id:
            tail = spark.read.schema(self._kept).parquet(self._folder("tail", batch_id - 1))
            newest = spark.read.schema("_us long").parquet(self._folder("clock", batch_id - 1)).first()[0]
        batch = batch.select(*self.schema.names).persist()
        try:
            late = F.coalesce(micros(batch, self.ts) < F.lit(newest).cast("long"), F.lit(False))
            batch.filter(late).write.mode("overwrite").parquet(self._folder("late", batch_id))
            fresh = batch.filter(~late)
            both = fresh.withColumn("_own", F.lit(True)).unionByName(
                tail.withColumn("_own", F.lit(False)), allowMissingColumns=True
            )
            counted = rate_rolling(both, self.ts, self.width_seconds, self.limit, self.key, self.hot_rows)
            counted.filter("_own").drop("_own").write.mode("overwrite").parquet(self._folder("out", batch_id))
            now = F.greatest(F.max(micros(fresh, self.ts)), F.lit(newest).cast("long"))
            last = fresh.agg(now.alias("_us"))
            last.write.mode("overwrite").parquet(self._folder("clock", batch_id))
            edge = spark.read.schema("_us long").parquet(self._folder("clock", batch_id)).first()[0]
            seen = fresh.select(*names).unionByName(tail)
            inside = micros(seen, self.ts) > F.lit(edge).cast("long") - self.width_seconds * 1_000_000
            seen.filter(inside).write.mode("overwrite").parquet(self._folder("tail", batch_id))
        finally:
            batch.unpersist()

    def _read(self, spark: SparkSession, kind: str, schema: T.StructType) -> DataFrame:
        with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        return spark.read.schema(with_batch).parquet(f"{self.root}/{kind}")

    def counted(self, spark: SparkSession) -> DataFrame:
        """The requests so far with ``in_window`` and ``breached``."""
        added = [T.StructField("in_window", T.LongType()), T.StructField("breached", T.BooleanType())]
        return self._read(spark, "out", T.StructType([*self.schema.fields, *added]))

    def late(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "late", self.schema)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Run on ``stream``; ``trigger`` is what Spark's ``trigger`` takes, by default all there is."""
        return (
            stream.writeStream.foreachBatch(self.step)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

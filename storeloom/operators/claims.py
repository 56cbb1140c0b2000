"""Claims on queued messages over successive runs, with leases that expire."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storeloom.operators.outbox import claim


@dataclass(frozen=True)
class ClaimTable:
    """The claims that runs made below ``root``, by run number.

    A claim holds its message until ``expires_at``; then the message can be claimed again, with
    one attempt more.  Every run writes a folder of its own, so a repeated run replaces itself.
    Two runs that overlap in time may write claims on the same message; the one with the lower
    number counts (``held``), so workers that ask after writing never share a message.
    """

    root: str
    row_id: str
    id_type: T.DataType
    lease_seconds: int

    @property
    def _schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(self.row_id, self.id_type),
                T.StructField("worker", T.LongType()),
                T.StructField("turn", T.IntegerType()),
                T.StructField("attempt", T.IntegerType()),
                T.StructField("claimed_at", T.TimestampNTZType()),
                T.StructField("expires_at", T.TimestampNTZType()),
                T.StructField("run", T.IntegerType()),
            ]
        )

    def claims(self, spark: SparkSession) -> DataFrame:
        """All claims written; none before the first run."""
        try:
            return spark.read.schema(self._schema).parquet(f"{self.root}/claims")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self._schema)

    def held(self, spark: SparkSession, run: int) -> DataFrame:
        """The claims of a run that no earlier run's claim was in the way of."""
        claims = self.claims(spark).filter(F.col("run") <= run)
        own = claims.filter(F.col("run") == run)
        # One row per message: the latest expiry that an earlier run had written.
        before = (
            claims.filter(F.col("run") < run)
            .groupBy(self.row_id)
            .agg(F.max("expires_at").alias("_until"))
        )
        free = F.col("_until").isNull() | (F.col("_until") <= F.col("claimed_at"))
        return own.join(before, self.row_id, "left").filter(free).drop("_until")

    def run(
        self,
        queue: DataFrame,
        run: int,
        as_of: Column,
        workers: int,
        per_worker: int,
        due: str,
        status: str,
        pending: str,
        done: DataFrame | None = None,
        max_attempts: int | None = None,
    ) -> DataFrame:
        """Claim what is due, free and not done, the oldest first; the claims that hold.

        ``done`` has the ids of messages that were sent.  The claims of earlier runs meet the
        queue as one row per message.
        """
        spark = queue.sparkSession
        before = (
            self.claims(spark)
            .filter(F.col("run") < run)
            .groupBy(self.row_id)
            .agg(F.max("expires_at").alias("_until"), F.max("attempt").alias("_attempts"))
        )
        open_ = queue.join(before, self.row_id, "left").filter(
            F.col("_until").isNull() | (F.col("_until") <= as_of)
        )
        if max_attempts is not None:
            open_ = open_.filter(F.coalesce("_attempts", F.lit(0)) < max_attempts)
        if done is not None:
            open_ = open_.join(done.select(self.row_id).distinct(), self.row_id, "left_anti")
        claimed = claim(open_, as_of, workers, per_worker, self.row_id, due, status, pending)
        claimed.select(
            self.row_id,
            F.col("worker").cast("long").alias("worker"),
            F.col("turn").cast("int").alias("turn"),
            (F.coalesce("_attempts", F.lit(0)) + 1).cast("int").alias("attempt"),
            as_of.alias("claimed_at"),
            (as_of + F.make_dt_interval(secs=F.lit(self.lease_seconds))).alias("expires_at"),
        ).write.mode("overwrite").parquet(f"{self.root}/claims/run={run}")
        return self.held(spark, run)

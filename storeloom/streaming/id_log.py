"""First delivery of each id on a stream, exact for ever, with nothing in Spark's state.

The ids seen are a log of files by day, each day behind a filter of bits.  A batch puts its
ids to the filters and looks up in the log only those that a filter may know, in the parts
of the days in question.  All files lie below the id of the batch that wrote them, so a
repeated batch sees what it saw before and replaces its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from storeloom.operators.dedup import first_by_key

# After so many batches their files are written together.
MERGE_EVERY = 16
# Words of 64 bits in a day's filter: one for every four ids that a day brings lets about
# one new id in two hundred through.  Fewer cost further look-ups, never the answer.
WORDS = 1 << 20
# Bits that an id sets in its word.
BITS = 5
# Parts of a day's ids: one for about a million that a day brings.
PARTS = 32
# The day of rows without a time.
NO_DAY = "none"


def _mask(key: Column) -> Column:
    """The bits of a key in its word, from a hash apart from the one that chooses the word."""
    h = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    ones = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
    return reduce(lambda a, b: a.bitwiseOR(b), ones)


@dataclass(frozen=True)
class IdLog:
    """The folders and rules of one stream.

    ``out`` has the first delivery of every id, ``ids`` the log by day and part, ``filters``
    a row (word, day, bits) per word in use, ``looks`` what each batch looked up.  Of one
    batch's rows with an id the first by ``ts`` and ``order`` counts, else the first batch.
    Rows without id all pass; those without time belong to a day of their own.
    """

    root: str
    schema: T.StructType
    key: str
    ts: str
    order: tuple[str, ...] = ()
    words: int = WORDS
    parts: int = PARTS
    merge_every: int = MERGE_EVERY

    def _sources(self, kind: str, batch_id: int) -> list[str]:
        """What the batches before ``batch_id`` wrote: sets written together, then single ones."""
        base = batch_id - batch_id % self.merge_every
        together = [f"{self.root}/{kind}/upto_{b}" for b in range(self.merge_every, base + 1, self.merge_every)]
        return together + [f"{self.root}/{kind}/batch_{b}" for b in range(base, batch_id)]

    @property
    def _id_schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField("_id", self.schema[self.key].dataType),
                T.StructField("_day", T.StringType()),
                T.StructField("_part", T.IntegerType()),
            ]
        )

    _filter_schema = "_word LONG, _day STRING, _bits LONG"

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """One row per id: its day, part, word and bits."""
        key = F.col(self.key)
        day = F.coalesce(F.date_format(F.col(self.ts), "yyyy-MM-dd"), F.lit(NO_DAY))
        h = F.xxhash64(key)
        return rows.filter(key.isNotNull()).select(
            key.alias("_id"),
            day.alias("_day"),
            F.pmod(F.shiftright(h, 40), F.lit(self.parts)).cast("int").alias("_part"),
            F.pmod(h, F.lit(self.words)).alias("_word"),
            _mask(key).alias("_mask"),
        )

    def _merge(self, spark: SparkSession, batch_id: int) -> None:
        """Write the files of the last batches together: an id moves once, however long the stream."""
        last = range(batch_id - self.merge_every, batch_id)
        ids = self._read_ids(spark, [f"{self.root}/ids/batch_{b}" for b in last])
        self._write_ids(ids, f"upto_{batch_id}")
        paths = [f"{self.root}/filters/batch_{b}" for b in last]
        bits = spark.read.schema(self._filter_schema).parquet(*paths)
        bits.groupBy("_word", "_day").agg(F.bit_or("_bits").alias("_bits")).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/filters/upto_{batch_id}")

    def _write_ids(self, ids: DataFrame, name: str) -> None:
        parts = ids.select("_id", "_day", "_part").repartition("_day", "_part")
        parts.write.mode("overwrite").partitionBy("_day", "_part").parquet(f"{self.root}/ids/{name}")

    def _read_ids(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """Every source is a table of its own, so that days and parts are found in its paths."""
        return reduce(
            DataFrame.unionByName,
            [spark.read.schema(self._id_schema).parquet(p) for p in paths],
        )

    def step(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Work on one micro-batch; the first deliveries in it, as written.

        Ids and filters meet in joins with one row per id on either side, so no id, however
        often it comes, weighs on one task.  Only the days (and parts) of possible hits are
        fetched by the driver, at most ``parts`` for each day of the log.
        """
        spark = batch.sparkSession
        if batch_id and batch_id % self.merge_every == 0:
            self._merge(spark, batch_id)
        order = [self.ts, *self.order]
        firsts = first_by_key(batch.select(*self.schema.names), [self.key], order).persist()
        try:
            return self._place(spark, firsts, batch_id)
        finally:
            firsts.unpersist()

    def _place(self, spark: SparkSession, firsts: DataFrame, batch_id: int) -> DataFrame:
        mine = self._keyed(firsts)
        if not batch_id:
            fresh, looks = firsts, mine.agg(F.count(F.lit(1)).alias("n_ids"), F.lit(0).alias("n_hits"))
            looks = looks.withColumns({"n_parts": F.lit(0), "n_seen": F.lit(0)})
        else:
            filters = spark.read.schema(self._filter_schema).parquet(*self._sources("filters", batch_id))
            known = F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
            asked = mine.select("_id", "_part", "_word", "_mask")
            hits = (
                filters.join(asked, "_word")
                .filter(known)
                .select("_id", "_day", "_part")
                .distinct()
                .persist()
            )
            parts = hits.select("_day", "_part").distinct().collect()
            seen = self._seen(spark, hits, parts, batch_id).persist()
            fresh = firsts.join(seen, F.col(self.key) == F.col("_id"), "left_anti")
            counts = [x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((mine, "n_ids"), (hits, "n_hits"))]
            n_ids, n_hits = (x.first()[0] for x in counts)
            looks = seen.agg(F.count(F.lit(1)).alias("n_seen")).select(
                F.lit(n_ids).alias("n_ids"), F.lit(n_hits).alias("n_hits"), F.lit(len(parts)).alias("n_parts"), "n_seen"
            )
        self._write(fresh, looks, batch_id)
        if batch_id:
            hits.unpersist()
            seen.unpersist()
        return spark.read.schema(self.schema).parquet(f"{self.root}/out/batch_id={batch_id}")

    def _seen(self, spark: SparkSession, hits: DataFrame, parts: list, batch_id: int) -> DataFrame:
        """The hits that the log really has; reads only the days and parts they lie in."""
        log = self._read_ids(spark, self._sources("ids", batch_id))
        days = sorted({r["_day"] for r in parts})
        places = sorted({r["_part"] for r in parts})
        log = log.filter(F.col("_day").isin(days) & F.col("_part").isin(places))
        return hits.join(log, ["_id", "_day", "_part"], "left_semi").select("_id").distinct()

    def _write(self, fresh: DataFrame, looks: DataFrame, batch_id: int) -> None:
        spark = fresh.sparkSession
        out = f"{self.root}/out/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(out)
        new = self._keyed(spark.read.schema(self.schema).parquet(out))
        self._write_ids(new, f"batch_{batch_id}")
        new.groupBy("_word", "_day").agg(F.bit_or("_mask").alias("_bits")).write.mode("overwrite").parquet(
            f"{self.root}/filters/batch_{batch_id}"
        )
        looks.select(*[F.col(c).cast("long") for c in ("n_ids", "n_hits", "n_parts", "n_seen")]).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/looks/batch_id={batch_id}")

    def kept(self, spark: SparkSession) -> DataFrame:
        """The first deliveries so far, with the batch they came in."""
        with_batch = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        return spark.read.schema(with_batch).parquet(f"{self.root}/out")

    def looks(self, spark: SparkSession) -> DataFrame:
        """Per batch: its ids, those a filter may know (per day), the parts they lie in, those
        that the log had."""
        schema = "n_ids LONG, n_hits LONG, n_parts LONG, n_seen LONG, batch_id LONG"
        return spark.read.schema(schema).parquet(f"{self.root}/looks")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Run on ``stream``; ``trigger`` is what Spark's ``trigger`` takes, by default all there is."""

        def work(batch: DataFrame, batch_id: int) -> None:
            self.step(batch, batch_id)

        return (
            stream.writeStream.foreachBatch(work)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

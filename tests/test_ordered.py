from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from storeloom.functions.clock import micros, weeks_starting
from storeloom.functions.ordered import running_count, running_sum


def test_running_sum_equals_a_plain_window(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        (F.hash("id") % 50).cast("long").alias("v"),
        "id",
    )
    plain = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.withColumn("s", F.sum("v").over(plain)))
    bucket = F.floor(F.col("id") / 100)
    for hot_rows in (0, 400, 10**6):
        got = running_sum(df, ["k"], bucket, [F.col("id")], F.col("v"), "s", hot_rows=hot_rows)
        assert rows(got) == want
    back = Window.partitionBy("k").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(back))
    got = running_sum(
        df, ["k"], bucket, [F.desc("id")], F.col("v"), "s", newest_first=True, hot_rows=400
    )
    assert rows(got) == rows(want)


def test_running_count_counts_null_keys_and_no_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 200), ("a", 3)], "k STRING, id INT")
    for hot_rows in (0, 10**6):
        bucket = F.floor(F.col("id") / 100)
        got = running_count(df, ["k"], bucket, [F.col("id")], "n", hot_rows)
        assert rows(got) == [("a", 3, 1), (None, 1, 1), (None, 200, 2)]
        got = running_count(df, [], bucket, [F.col("id")], "n", hot_rows)
        assert sorted(r.n for r in got.collect()) == [1, 2, 3]


def test_micros_is_free_of_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.123456' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(micros(df, "ts")).first()[0] == 1710037800123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_weeks_turn_on_monday_at_eight(spark):
    df = spark.sql(
        "SELECT explode(array(TIMESTAMP_NTZ '2024-01-08 07:59:59', TIMESTAMP_NTZ '2024-01-08 08:00:00'))"
        " AS ts"
    )
    got = [str(r[0]) for r in df.select(weeks_starting(F.col("ts"), "4 days 8 hours")).collect()]
    assert got == ["2024-01-01 08:00:00", "2024-01-08 08:00:00"]

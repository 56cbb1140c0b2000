from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from storeloom.plans.backup import SnapshotMismatch, backup, restore
from storeloom.session import shared_folder, work_folder
from storeloom.sources import payloads, snapshots, tables


def test_declared_tables_scan_with_money_as_decimal(spark, tmp_path):
    spark.createDataFrame(
        [(1, 10, 7, 12.345, "pago", datetime(2024, 1, 1))],
        "id BIGINT, numero_pedido BIGINT, cliente_id BIGINT, valor_total DOUBLE, "
        "status_operacional STRING, data_criacao TIMESTAMP_NTZ",
    ).write.parquet(str(tmp_path / "pedidos.parquet"))
    stored_as_double = {
        "pedidos": tables.SHOP_TABLES["pedidos"].replace("valor_total DECIMAL(10,2)", "valor_total DOUBLE")
    }
    df = tables.read_tables(
        spark, str(tmp_path), ["pedidos"], stored_as_double, {"pedidos": ["valor_total"]}
    )["pedidos"]
    row = df.first()
    assert row.valor_total == Decimal("12.35")
    assert row.codigo_rastreio is None
    assert [f.name for f in df.schema][:3] == ["id", "numero_pedido", "cliente_id"]


def test_all_declared_schemas_parse(spark):
    for ddl in tables.SHOP_TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_explode_list_keeps_positions_and_survives_bad_documents(spark):
    df = spark.createDataFrame(
        [(1, '{"a": {"items": [{"x": 5}, {"x": 6, "y": 1}]}}'), (2, "oops"), (3, '{"a": {"items": []}}'), (4, None)],
        "id INT, doc STRING",
    )
    got = payloads.explode_list(df, "doc", "a.items", "x INT")
    assert rows(got) == [(1, 0, 5), (1, 1, 6)]


def test_payload_fields(spark):
    df = spark.createDataFrame(
        [(1, '{"a": {"b": 3}, "s": "x"}'), (2, '{"a": {"b": "no"}}'), (3, "{broken"), (4, None)],
        "id INT, raw STRING",
    )
    got = payloads.payload_fields(df, "raw", {"b": ("$.a.b", "int"), "s": ("$.s", "string")})
    assert rows(got.drop("raw")) == [(1, 3, "x"), (2, None, None), (3, None, None), (4, None, None)]


def test_snapshot_verifies_and_a_changed_one_does_not(spark):
    source = {"t": spark.createDataFrame([(1, "a"), (2, None)], "id INT, v STRING")}
    root = work_folder(spark, "test")
    snapshots.write_snapshot(source, root, "2024-01-01")
    snapshots.write_snapshot(source, root, "2024-01-01")

    def verify(snap):
        return snapshots.verify_snapshot(source, {"t": snap}).first()

    good = snapshots.read_snapshot(spark, root, "t", "2024-01-01")
    assert tuple(verify(good)) == ("t", 2, 2, True)
    assert verify(good.fillna("x")).matches is False
    assert verify(good.limit(1)).matches is False
    assert verify(good.withColumn("id", F.col("id").cast("bigint"))).matches is False
    empty = {"t": source["t"].limit(0)}
    assert snapshots.verify_snapshot(empty, empty).first().matches is True


def test_latest_snapshot_reads_one_partition(spark):
    root = work_folder(spark, "test")
    for day, v in (("2024-01-01", 1), ("2024-01-03", 3), ("2024-01-02", 2)):
        snapshots.write_snapshot({"t": spark.createDataFrame([(v,)], "v INT")}, root, day)
    latest = snapshots.latest_snapshot(spark, root, "t")
    assert rows(latest) == [(3, date(2024, 1, 3))]
    assert all("2024-01-03" in f for f in latest.inputFiles())
    with pytest.raises(FileNotFoundError):
        snapshots.latest_snapshot(spark, root, "other")
    all_days = spark.read.parquet(f"{root}/t")
    newest = snapshots.latest_partition(all_days, "snapshot_date")
    assert rows(newest) == [(3, date(2024, 1, 3))]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_retention_edge(spark):
    df = spark.sql("SELECT explode(array(date'2024-01-23', date'2024-01-22')) AS d")
    got = snapshots.retention(df, "d", F.lit("2024-01-30").cast("date")).collect()
    assert [(r.age_days, r.drop_it) for r in got] == [(7, False), (8, True)]


def test_backup_and_restore(spark, monkeypatch):
    root = work_folder(spark, "test")
    t = spark.createDataFrame([(1,), (2,)], "v INT")
    assert backup(spark, {"t": t}, root, "2024-01-01").first().matches
    assert rows(restore(spark, root, ["t"])["t"].select("v")) == [(1,), (2,)]
    monkeypatch.setattr("storeloom.plans.backup.read_snapshot", lambda *a: t.limit(1))
    with pytest.raises(SnapshotMismatch):
        backup(spark, {"t": t}, root, "2024-01-02")


def test_work_folder_lies_in_the_named_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark, "x").startswith(shared_folder(spark) + "/storeloom/x-")


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_a_rejected_snapshot_is_never_restored(spark, monkeypatch):
    root = work_folder(spark, "test")
    day1, day2 = (spark.createDataFrame([(v,)], "v INT") for v in (1, 2))
    backup(spark, {"t": day1}, root, "2024-01-01")
    with monkeypatch.context() as m:
        m.setattr("storeloom.plans.backup.read_snapshot", lambda *a: day1)
        with pytest.raises(SnapshotMismatch):
            backup(spark, {"t": day2}, root, "2024-01-02")
    assert rows(restore(spark, root, ["t"])["t"].select("v")) == [(1,)]


def test_a_broken_rerun_leaves_the_good_copy(spark):
    root = work_folder(spark, "test")
    good = spark.createDataFrame([(1,)], "v INT")
    backup(spark, {"t": good}, root, "2024-01-01")
    broken = spark.range(2).select(F.raise_error(F.lit("disk full")).cast("int").alias("v"))
    with pytest.raises(Exception, match="disk full"):
        backup(spark, {"t": broken}, root, "2024-01-01")
    assert rows(restore(spark, root, ["t"])["t"].select("v")) == [(1,)]
    backup(spark, {"t": spark.createDataFrame([(5,)], "v INT")}, root, "2024-01-01")
    assert rows(restore(spark, root, ["t"])["t"]) == [(5, date(2024, 1, 1))]

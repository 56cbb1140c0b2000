from datetime import datetime

from pyspark.sql import functions as F

from storeloom.sources.shop_rules import DECLARED, declared_audit, with_defaults
from storeloom.sources.tables import SHOP_TABLES


def test_rules_name_columns_of_their_tables():
    for name, own in DECLARED.items():
        columns = {c.split()[0] for c in SHOP_TABLES[name].split(", ")}
        named = {own.key, *own.not_null, *own.unique, *own.lengths, *own.dimensions, *own.parents, *own.defaults}
        assert named <= columns, name
    assert set(DECLARED) == set(SHOP_TABLES)


def test_audit_counts_each_broken_rule(spark):
    clients = spark.createDataFrame(
        [(1, "A", "x@x", "1" * 15), (1, None, "x@x", None), (None, "C", None, None)],
        "id long, nome string, email string, documento string",
    ).selectExpr("*", "nome AS razao_social", "nome AS whatsapp", "nome AS grupo", "id AS chatwoot_contact_id")
    orders = spark.createDataFrame(
        [(1, 1, 1.0, "s", datetime(2024, 1, 1)), (2, 9, None, "s", None)],
        "id long, cliente_id long, valor_total double, status_operacional string, data_criacao timestamp",
    ).selectExpr("*", "id AS numero_pedido", "'' AS envio_id", "'' AS codigo_rastreio", "repeat('9', 45) AS chave_fiscal")
    report = declared_audit({"clientes": clients, "pedidos": orders})
    broken = {(r.table_name, r.rule, r.column_name): r.violations for r in report.collect() if r.violations}
    assert broken == {
        ("clientes", "not_null", "id"): 1,
        ("clientes", "not_null", "nome"): 1,
        ("clientes", "unique", "id"): 1,
        ("clientes", "unique", "email"): 1,
        ("clientes", "unique", "chatwoot_contact_id"): 1,
        ("clientes", "max_length", "documento"): 1,
        ("pedidos", "not_null", "valor_total"): 1,
        ("pedidos", "not_null", "data_criacao"): 1,
        ("pedidos", "max_length", "chave_fiscal"): 2,
        ("pedidos", "foreign_key", "cliente_id"): 1,
    }


def test_defaults_fill_and_add_columns(spark):
    rows = spark.createDataFrame([("a", None, 3), ("b", 7, None)], "item_nome string, quantidade_atual int, estoque_minimo int")
    at = datetime(2024, 5, 1)
    stored = with_defaults("insumos", rows, F.lit(at)).orderBy("item_nome").collect()
    assert [tuple(r) for r in stored] == [("a", 0, 3, at), ("b", 7, 10, at)]

"""The declared rules and defaults of the shop's tables, on rows made of the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeloom.plans.fixtures import ntz, table
from storeloom.plans.registry import query
from storeloom.sources.shop_rules import declared_audit, with_defaults

# Source and columns of each table, in SQL that both engines read; all break some rules.
SHOP = {
    "base_conhecimento": (
        "documents",
        "doc_id AS id, CASE WHEN doc_id % 9 <> 0 THEN source END AS titulo, text AS conteudo, "
        "repeat(lang, CAST(doc_id % 60 AS INT)) AS categoria",
    ),
    "clientes": (
        "customer",
        "c_custkey AS id, CASE WHEN c_custkey % 8 <> 0 THEN c_name END AS nome, "
        "concat('c', CAST(c_custkey % 90 AS STRING)) AS email, "
        "repeat('1', CAST(c_custkey % 20 AS INT)) AS documento, c_name AS razao_social, "
        "repeat('5', CAST(c_nationkey AS INT)) AS whatsapp, c_mktsegment AS grupo, "
        "CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS chatwoot_contact_id",
    ),
    "pedidos": (
        "orders",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS id, "
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS numero_pedido, "
        "o_custkey + 5 AS cliente_id, o_totalprice AS valor_total, o_orderstatus AS status_operacional, "
        "o_orderpriority AS envio_id, CAST(NULL AS STRING) AS codigo_rastreio, "
        "repeat('9', CAST(o_orderkey % 50 AS INT)) AS chave_fiscal, o_orderdate AS data_criacao",
    ),
    "insumos": (
        "part",
        "p_partkey % 100 AS id, p_name AS item_nome, p_size AS quantidade_atual, "
        "CASE WHEN p_size % 4 <> 0 THEN p_size END AS estoque_minimo, p_brand AS fornecedor_nome, "
        "repeat(p_type, 16) AS fornecedor_contato",
    ),
    "leads": (
        "events",
        "event_id AS id, CASE WHEN event_type <> 'view' THEN event_type END AS origem_captura, "
        "props AS documento_pj, event_type AS contato_identificado, "
        "CASE WHEN event_id % 3 <> 0 THEN event_type END AS status_funil, "
        "user_id AS chatwoot_conversation_id",
    ),
    "catalogo": (
        "part",
        "p_partkey AS id_interno, p_type AS sku, "
        "CASE WHEN p_brand <> 'Brand#4' THEN p_name END AS nome, p_size AS quantidade_estoque",
    ),
    "fila_mensageria": (
        "events",
        "event_id AS id, props AS documento_pj, "
        "CASE WHEN user_id % 6 <> 0 THEN CAST(user_id AS STRING) END AS whatsapp, "
        "CASE WHEN event_id % 2 = 0 THEN event_type END AS status, "
        "CASE WHEN event_id % 5 = 0 THEN event_id END AS tentativas",
    ),
    "schema_version": ("region", "repeat(r_name, CAST(r_regionkey * 20 AS INT)) AS versao"),
    "processed_events": (
        "events",
        "concat(event_type, CAST(user_id AS STRING)) AS event_id, "
        "CASE WHEN event_id % 4 <> 0 THEN event_type END AS webhook_topic",
    ),
}
DIMENSION = "vec_id AS id, embedding"


def _shop_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = SHOP[name]
    return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=table(spark, sf_dir, source))


# Table and column by rule, with the width where there is one.
NOT_NULL = (
    "base_conhecimento.id base_conhecimento.titulo base_conhecimento.conteudo clientes.id "
    "clientes.nome pedidos.id pedidos.numero_pedido pedidos.valor_total "
    "pedidos.status_operacional pedidos.data_criacao insumos.id insumos.item_nome "
    "insumos.quantidade_atual insumos.estoque_minimo leads.id leads.origem_captura "
    "catalogo.id_interno catalogo.sku catalogo.nome catalogo.quantidade_estoque "
    "fila_mensageria.id fila_mensageria.documento_pj fila_mensageria.whatsapp "
    "schema_version.versao processed_events.event_id processed_events.webhook_topic"
).split()
UNIQUE = (
    "base_conhecimento.id clientes.id clientes.email clientes.documento "
    "clientes.chatwoot_contact_id pedidos.id insumos.id insumos.item_nome leads.id "
    "leads.chatwoot_conversation_id catalogo.id_interno catalogo.sku fila_mensageria.id "
    "schema_version.versao processed_events.event_id"
).split()
WIDTHS = (
    "base_conhecimento.titulo:255 base_conhecimento.categoria:100 clientes.nome:255 "
    "clientes.email:255 clientes.documento:14 clientes.razao_social:255 clientes.whatsapp:20 "
    "clientes.grupo:100 pedidos.status_operacional:100 pedidos.envio_id:100 "
    "pedidos.codigo_rastreio:100 pedidos.chave_fiscal:44 insumos.item_nome:255 "
    "insumos.fornecedor_nome:255 insumos.fornecedor_contato:100 leads.origem_captura:100 "
    "leads.documento_pj:14 leads.contato_identificado:255 leads.status_funil:50 catalogo.sku:100 "
    "catalogo.nome:255 fila_mensageria.documento_pj:14 fila_mensageria.whatsapp:20 "
    "fila_mensageria.status:50 schema_version.versao:255 processed_events.event_id:255 "
    "processed_events.webhook_topic:100"
).split()


def _audit_sql() -> str:
    tables = ", ".join(f"{t} AS (SELECT {columns} FROM {source})" for t, (source, columns) in SHOP.items())
    lines = []
    for at in NOT_NULL:
        t, c = at.split(".")
        lines.append(f"SELECT '{t}' AS table_name, 'not_null' AS rule, '{c}' AS column_name, "
                     f"count(*) FILTER ({c} IS NULL) AS violations FROM {t}")  # fmt: skip
    for at in UNIQUE:
        t, c = at.split(".")
        lines.append(f"SELECT '{t}', 'unique', '{c}', count({c}) - count(DISTINCT {c}) FROM {t}")
    for at in WIDTHS:
        t, c = at.split(":")[0].split(".")
        lines.append(f"SELECT '{t}', 'max_length', '{c}', count(*) FILTER (length({c}) > {at.split(':')[1]}) FROM {t}")
    lines.append("SELECT 'base_conhecimento', 'dimension', 'embedding', count(embedding) FROM embeddings")
    lines.append("SELECT 'pedidos', 'foreign_key', 'cliente_id', count(*) FROM pedidos "
                 "WHERE cliente_id NOT IN (SELECT id FROM clientes)")  # fmt: skip
    return f"WITH {tables} " + " UNION ALL ".join(lines)


@query("declared_audit", _audit_sql())
def declared_audit_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All declared rules of the nine tables."""
    tables = {name: _shop_table(spark, sf_dir, name) for name in SHOP}
    # The vectors have 64 entries, not the declared number; some entries are without one.
    vectors = table(spark, sf_dir, "embeddings").selectExpr(*DIMENSION.split(", "))
    knowledge = tables["base_conhecimento"].withColumn("embedding", F.lit(None).cast("array<float>"))
    report = declared_audit(tables | {"base_conhecimento": knowledge})
    only = declared_audit(
        {
            "base_conhecimento": vectors.select(
                "id",
                F.lit("t").alias("titulo"),
                F.lit("c").alias("conteudo"),
                F.lit(None).cast("string").alias("categoria"),
                "embedding",
            )
        }
    )
    wrong_size = F.col("rule") == "dimension"
    return report.filter(~wrong_size).unionByName(only.filter(wrong_size))


LOADED = "2024-02-01 00:00:00"


@query(
    "declared_defaults",
    f"""
    SELECT event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'pendente') AS status,
           coalesce(CASE WHEN event_id % 5 = 0 THEN event_id END, 0) AS tentativas,
           coalesce(CASE WHEN event_id % 7 = 0 THEN ts END, TIMESTAMP '{LOADED}') AS data_agendamento,
           coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, 'Frio') AS status_funil,
           TIMESTAMP '{LOADED}' AS data_captura
    FROM events
    """,
)
def declared_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and leads as they are stored, times and states left out in part or in whole."""
    queue = _shop_table(spark, sf_dir, "fila_mensageria")
    at = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("data_agendamento")
    )
    stored = with_defaults("fila_mensageria", queue.join(at, "id"), ntz(LOADED))
    leads = with_defaults("leads", _shop_table(spark, sf_dir, "leads"), ntz(LOADED))
    return stored.select("id", "status", "tentativas", "data_agendamento").join(
        leads.select("id", "status_funil", "data_captura"), "id"
    )

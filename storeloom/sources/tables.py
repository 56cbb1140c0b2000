"""Typed table scans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

# The shop's declared tables (names, order and widths of columns).
SHOP_TABLES = {
    "base_conhecimento": (
        "id INT, titulo STRING, conteudo STRING, categoria STRING, "
        "embedding ARRAY<FLOAT>, data_atualizacao TIMESTAMP_NTZ"
    ),
    "clientes": (
        "id BIGINT, nome STRING, email STRING, documento STRING, razao_social STRING, "
        "whatsapp STRING, grupo STRING, chatwoot_contact_id BIGINT, data_cadastro TIMESTAMP_NTZ"
    ),
    "pedidos": (
        "id BIGINT, numero_pedido BIGINT, cliente_id BIGINT, valor_total DECIMAL(10,2), "
        "status_operacional STRING, envio_id STRING, codigo_rastreio STRING, "
        "chave_fiscal STRING, data_criacao TIMESTAMP_NTZ"
    ),
    "insumos": (
        "id INT, item_nome STRING, quantidade_atual INT, estoque_minimo INT, "
        "fornecedor_nome STRING, fornecedor_contato STRING, ultima_atualizacao TIMESTAMP_NTZ"
    ),
    "leads": (
        "id INT, origem_captura STRING, perfil_ou_link STRING, documento_pj STRING, "
        "contato_identificado STRING, status_funil STRING, payload_raw STRING, "
        "chatwoot_conversation_id BIGINT, data_captura TIMESTAMP_NTZ"
    ),
    "catalogo": (
        "id_interno BIGINT, sku STRING, nome STRING, preco_cheio DECIMAL(10,2), "
        "quantidade_estoque INT, data_sincronizacao TIMESTAMP_NTZ"
    ),
    "fila_mensageria": (
        "id INT, documento_pj STRING, whatsapp STRING, status STRING, tentativas INT, "
        "data_agendamento TIMESTAMP_NTZ"
    ),
    "processed_events": "event_id STRING, webhook_topic STRING, processed_at TIMESTAMP_NTZ",
    "schema_version": "versao STRING, data_aplicacao TIMESTAMP_NTZ",
}


def read_tables(
    spark: SparkSession,
    directory: str,
    names: Iterable[str],
    schemas: Mapping[str, str] = SHOP_TABLES,
    money: Mapping[str, Iterable[str]] | None = None,
) -> dict[str, DataFrame]:
    """Scan ``directory/<name>.parquet`` with a declared schema, money as decimal(10,2).

    Giving the schema keeps planning free of file-footer reads.  Money columns that
    are stored as doubles are cast here, once; all other columns stay plain
    attributes, so filters and pruning on them still reach the parquet reader.
    """
    frames = {}
    for name in names:
        df = spark.read.schema(schemas[name]).parquet(f"{directory}/{name}.parquet")
        casts = {c: F.col(c).cast(MONEY) for c in (money or {}).get(name, ())}
        frames[name] = df.withColumns(casts) if casts else df
    return frames

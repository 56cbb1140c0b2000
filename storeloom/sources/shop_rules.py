"""The rules and defaults that the shop's nine tables declare, as data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeloom.operators.keyed import RowRule, constraint_audit, fill_defaults, max_length, not_null

# Stands for the time of loading.
NOW = object()


@dataclass(frozen=True)
class Declared:
    """What one table declares; the key is unique and never null."""

    key: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    lengths: Mapping[str, int] = field(default_factory=dict)
    dimensions: Mapping[str, int] = field(default_factory=dict)
    parents: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)


# The declarations of the shop's tables.
DECLARED = {
    "base_conhecimento": Declared(
        "id",
        not_null=("titulo", "conteudo"),
        lengths={"titulo": 255, "categoria": 100},
        dimensions={"embedding": 768},
        defaults={"data_atualizacao": NOW},
    ),
    "clientes": Declared(
        "id",
        not_null=("nome",),
        unique=("email", "documento", "chatwoot_contact_id"),
        lengths={
            "nome": 255, "email": 255, "documento": 14, "razao_social": 255, "whatsapp": 20, "grupo": 100
        },
        defaults={"data_cadastro": NOW},
    ),
    "pedidos": Declared(
        "id",
        not_null=("numero_pedido", "valor_total", "status_operacional", "data_criacao"),
        lengths={"status_operacional": 100, "envio_id": 100, "codigo_rastreio": 100, "chave_fiscal": 44},
        parents={"cliente_id": "clientes"},
    ),
    "insumos": Declared(
        "id",
        not_null=("item_nome", "quantidade_atual", "estoque_minimo"),
        unique=("item_nome",),
        lengths={"item_nome": 255, "fornecedor_nome": 255, "fornecedor_contato": 100},
        defaults={"quantidade_atual": 0, "estoque_minimo": 10, "ultima_atualizacao": NOW},
    ),
    "leads": Declared(
        "id",
        not_null=("origem_captura",),
        unique=("chatwoot_conversation_id",),
        lengths={"origem_captura": 100, "documento_pj": 14, "contato_identificado": 255, "status_funil": 50},
        defaults={"status_funil": "Frio", "data_captura": NOW},
    ),
    "catalogo": Declared(
        "id_interno",
        not_null=("sku", "nome", "quantidade_estoque"),
        unique=("sku",),
        lengths={"sku": 100, "nome": 255},
        defaults={"quantidade_estoque": 0, "data_sincronizacao": NOW},
    ),
    "fila_mensageria": Declared(
        "id",
        not_null=("documento_pj", "whatsapp"),
        lengths={"documento_pj": 14, "whatsapp": 20, "status": 50},
        defaults={"status": "pendente", "tentativas": 0, "data_agendamento": NOW},
    ),
    "schema_version": Declared("versao", lengths={"versao": 255}, defaults={"data_aplicacao": NOW}),
    "processed_events": Declared(
        "event_id",
        not_null=("webhook_topic",),
        lengths={"event_id": 255, "webhook_topic": 100},
        defaults={"processed_at": NOW},
    ),
}


def dimension(col: str, n: int) -> RowRule:
    return RowRule("dimension", col, F.size(col) != n)


def declared_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per declared rule of the given tables: ``table_name``, ``rule``,
    ``column_name``, ``violations``.

    A reference to a table that is not given is not checked.  Each table's row rules share
    one scan; unique columns and references are counted per value first.
    """
    reports = []
    for name, df in tables.items():
        own = DECLARED[name]
        rules = [not_null(c) for c in (own.key, *own.not_null)]
        rules += [max_length(c, n) for c, n in own.lengths.items()]
        rules += [dimension(c, n) for c, n in own.dimensions.items()]
        parents = {
            c: (tables[parent].filter(F.col(DECLARED[parent].key).isNotNull()), DECLARED[parent].key)
            for c, parent in own.parents.items()
            if parent in tables
        }
        report = constraint_audit(df, rules, [own.key, *own.unique], parents)
        reports.append(report.select(F.lit(name).alias("table_name"), "rule", "column_name", "violations"))
    return reduce(DataFrame.unionByName, reports)


def with_defaults(name: str, df: DataFrame, loaded_at: Column) -> DataFrame:
    """The rows of a table as they are stored: what they leave out takes its declared default.

    A column that the rows lack altogether is added at the end.
    """
    defaults = {c: loaded_at if v is NOW else F.lit(v) for c, v in DECLARED[name].defaults.items()}
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    given = {c: v for c, v in defaults.items() if c in df.columns}
    return fill_defaults(df, given).withColumns(missing)

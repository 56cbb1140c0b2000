"""Reading nested and raw JSON payload columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_list(
    df: DataFrame, json_col: str, path: str, item_ddl: str, pos: str = "pos"
) -> DataFrame:
    """One row per element of the list at ``path`` of a JSON document column.

    ``pos`` keeps the element's place in the source list, which is what "first" and
    "last" refer to later on.  A document that cannot be parsed yields no rows and
    never stops the other documents.
    """
    names = path.split(".")
    ddl = f"ARRAY<STRUCT<{item_ddl}>>"
    for name in reversed(names):
        ddl = f"STRUCT<{name}: {ddl}>"
    others = [c for c in df.columns if c != json_col]
    parsed = df.select(*others, F.from_json(json_col, ddl).alias("_doc"))
    items = parsed.select(*others, F.posexplode(F.col("_doc." + path)).alias(pos, "_item"))
    return items.select(*others, pos, "_item.*")


def payload_fields(
    df: DataFrame, col: str, fields: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Add typed fields picked out of a raw JSON column: ``{name: (path, type)}``.

    The document is parsed once per row; broken JSON, missing paths and values of
    another type all come out as null.
    """
    parsed = df.withColumn("_payload", F.try_parse_json(F.col(col)))

    def pick(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("_payload"), path, kind)

    return parsed.withColumns({n: pick(p, k) for n, (p, k) in fields.items()}).drop("_payload")

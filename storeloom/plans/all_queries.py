"""All registered queries, by name."""

from storeloom.plans import (  # noqa: F401  (each module registers its queries)
    catalog_queries,
    declared_queries,
    keyed_queries,
    search_queries,
    shop_queries,
    stream_queries,
    sync_queries,
    tables_queries,
    traffic_queries,
)
from storeloom.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

"""All registered queries, gathered from the catalog modules."""

from pagequarry.plans import catalog_relations, catalog_streams, catalog_topics  # noqa: F401
from pagequarry.plans.catalog import CATALOG

__all__ = ["CATALOG"]

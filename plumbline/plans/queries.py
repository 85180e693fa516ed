"""All registered queries."""

from plumbline.plans import column_queries, dataset_queries, discovery_queries, reader_queries, schema_queries, state_queries, store_queries, text_queries  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES  # noqa: F401

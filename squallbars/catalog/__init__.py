"""All registered queries."""

from squallbars.catalog import bar_queries, label_queries, text_queries, event_queries, metric_queries, model_queries, plan_queries, source_queries  # noqa: F401
from squallbars.catalog.registry import CHECKS, QUERIES  # noqa: F401

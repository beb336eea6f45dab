"""All registered queries and the SQL they are checked against."""

from . import decision_queries, metric_queries, model_queries, panel_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

"""Score the panel, measure it, and list what has to be reordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import SERVICE_LEVELS
from ..operators.clean import clean_panel, drop_unscored
from ..operators.inventory import DEMAND, at_risk, inventory_policy
from ..operators.metrics import accuracy_of, assessment, store_section
from ..sources.panel import write_reorders
from .evaluation import report_metrics, section
from .recommend import scored_history


def reorder_recommendations(
    panel: DataFrame,
    forecaster,
    lead_time_weeks: float = 1,
    service_level: float = SERVICE_LEVELS["95%"],
    scope: str = "all_rows",
) -> DataFrame:
    """Rows below their reorder point, with the quantity to order."""
    scored = scored_history(clean_panel(panel), forecaster)
    demand = scored.withColumnRenamed("predicted", DEMAND)
    return at_risk(inventory_policy(demand, lead_time_weeks, service_level), scope)


def reorder_report(
    panel: DataFrame, forecaster, path: str | None = None, fmt: str = "csv", **policy
) -> dict[str, DataFrame]:
    """Accuracy overall and by store, its grade, and the reorder table."""
    scored = drop_unscored(scored_history(clean_panel(panel), forecaster))
    demand = scored.withColumn(DEMAND, F.col("predicted"))
    passed = report_metrics(scored, ("overall", "by_store"))
    report = {
        "metrics": assessment(section(passed, "overall")),
        "by_store": store_section(accuracy_of(section(passed, "by_store"), ["store_id"])),
        "reorders": at_risk(inventory_policy(demand, **policy)),
    }
    if path is not None:
        write_reorders(report["reorders"], path, fmt)
    return report

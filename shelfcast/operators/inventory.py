"""Safety stock, reorder points and order quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..schema import DATE, SERIES
from ..sources.panel import REORDER_COLUMNS
from .history import latest_row
from .joins import split_join

DEMAND = "predicted_weekly_demand"


def series_demand_stats(
    df: DataFrame, demand: str = DEMAND, keys: Sequence[str] = SERIES, preaggregate: bool = False
) -> DataFrame:
    """Mean and sample deviation of each series' demand, on all of its rows.

    After the features the rows already lie by series, so a window needs no
    exchange. ``preaggregate`` computes the two numbers with a partial aggregate
    and joins them back, for input whose series have no length bound.
    """
    mean, deviation = F.avg(demand), F.stddev_samp(demand)
    if preaggregate:
        stats = df.groupBy(*keys).agg(
            mean.alias("avg_weekly_demand"),
            F.coalesce(deviation, F.lit(0.0)).alias("demand_std"),
        )
        return split_join(df, stats, keys)
    window = Window.partitionBy(*keys)
    return df.withColumns(
        {
            "avg_weekly_demand": mean.over(window),
            "demand_std": F.coalesce(deviation.over(window), F.lit(0.0)),
        }
    )


def inventory_policy(
    df: DataFrame,
    lead_time_weeks: float = 1,
    service_level: float = rules.SERVICE_LEVELS["95%"],
    demand: str = DEMAND,
    preaggregate: bool = False,
) -> DataFrame:
    """Add demand statistics, safety stock, reorder point, order and risk flag."""
    stats = series_demand_stats(df, demand, preaggregate=preaggregate)
    stock = F.col("inventory_level")
    return (
        stats.withColumn(
            "safety_stock",
            rules.safety_stock(F.col("demand_std"), lead_time_weeks, service_level),
        )
        .withColumn(
            "reorder_point",
            rules.reorder_point(F.col("avg_weekly_demand"), F.col("safety_stock"), lead_time_weeks),
        )
        .withColumn("order_quantity", rules.order_quantity(F.col("reorder_point"), stock))
        .withColumn("stockout_risk", rules.stockout_risk(F.col("reorder_point"), stock))
    )


def at_risk(df: DataFrame, scope: str = "all_rows") -> DataFrame:
    """Rows below their reorder point; ``scope="latest"`` looks at each series' last row only."""
    if scope == "latest":
        df = latest_row(df)
    keep = [DATE] if DATE in df.columns else []
    return df.filter(F.col("stockout_risk") == 1).select(*keep, *REORDER_COLUMNS)


def top_reorders(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` reorder rows in panel order."""
    return df.orderBy(*SERIES, DATE).limit(n)

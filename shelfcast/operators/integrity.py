"""Key checks of the relational tables, as reports of what breaks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, FOREIGN_KEYS, SERIES


def orphan_rows(fact: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose ``key`` has no row in ``parent``."""
    keys = parent.select(F.col(parent_key).alias(key)).distinct()
    return fact.join(keys, key, "left_anti")


def check_foreign_keys(name: str, fact: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(table, key, value, rows) of each key value that points nowhere.

    Equal key values are counted before the join, so a value that fills most of
    the table meets its parent once.
    """
    report = None
    for key, (parent, parent_key) in FOREIGN_KEYS[name].items():
        values = fact.groupBy(F.col(key).cast("long").alias("value")).agg(
            F.count(F.lit(1)).alias("rows")
        )
        known = parents[parent].select(F.col(parent_key).cast("long").alias("value"))
        missing = values.join(known, "value", "left_anti").select(
            F.lit(name).alias("table"), F.lit(key).alias("key"), "value", "rows"
        )
        report = missing if report is None else report.unionByName(missing)
    return report


def longest_series(df: DataFrame, keys: Sequence[str] = SERIES, order: str = DATE) -> DataFrame:
    """Rows of the longest series and the days the panel spans, as one row.

    With unique (series, date) rows the first cannot exceed the second; input
    where it does needs ``upsert_keep_last`` or segmented features.
    """
    lengths = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_first"), F.max(order).alias("_last")
    )
    return lengths.agg(
        F.max("_rows").alias("rows"),
        (F.date_diff(F.max("_last"), F.min("_first")) + 1).alias("days"),
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)

"""Latest rows, recent errors and history listings per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import (
    abs_pct_error,
    date_text,
    half_up,
    np_round,
    py_round,
    ratio,
    whole,
)
from ..schema import DATE, SERIES, TARGET

ERROR_ROWS = 30
WEEKS_PER_MONTH = 4


def newest_first(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys).orderBy(F.col(DATE).desc())


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last ``n`` rows of each series, with ``recency`` 1 for the newest.

    Spark applies the limit before the shuffle as well as after it.
    """
    ranked = df.withColumn("recency", F.row_number().over(newest_first(keys)))
    return ranked.filter(F.col("recency") <= n)


def latest_row(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The newest row of each series."""
    return last_rows(df, 1, keys).drop("recency")


def first_category(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by("category", DATE).alias("category"))


def recent_error(
    df: DataFrame, n: int = ERROR_ROWS, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Mean percentage error of each series' last ``n`` rows.

    Rows with zero demand have no percentage error and do not count; a series
    with no other rows gets null.
    """
    error = abs_pct_error(F.col(actual), F.col(predicted))
    return last_rows(df, n).groupBy(*SERIES).agg(F.avg(error).alias("mean_error"))


def dated_values(actual: str = "actual", predicted: str = "predicted") -> Column:
    """(date text, predicted, actual) rounded to cents, for nested listings."""
    return F.struct(
        date_text(DATE).alias("date"),
        np_round(predicted).alias("predicted"),
        np_round(actual).alias("actual"),
    )


def last_n(
    df: DataFrame, n: int, name: str, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Each series' last ``n`` rows as an array, oldest first."""
    return (
        last_rows(df, n)
        .groupBy(*SERIES)
        .agg(F.array_sort(F.collect_list(dated_values(actual, predicted))).alias(name))
    )


def history_report(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Actual, predicted, stock, price and discount by date, rounded to cents.

    Rows of a series that lie together, as scoring leaves them, are in date
    order; there is no order among series.
    """
    return df.select(
        *SERIES,
        date_text(DATE).alias("date"),
        np_round(TARGET).alias(TARGET),
        np_round(predicted).alias("predicted"),
        "inventory_level",
        np_round("price").alias("price"),
        np_round("discount").alias("discount"),
    ).sortWithinPartitions(*SERIES, "date")


def forecast_tail(df: DataFrame, months: int, predicted: str = "predicted") -> DataFrame:
    """The last ``4 * months`` fitted values of each series, numbered from 1.

    These are fitted values of past rows, not projections.
    """
    tail = last_rows(df, months * WEEKS_PER_MONTH)
    oldest_first = Window.partitionBy(*SERIES).orderBy(F.col("recency").desc())
    return tail.select(
        *SERIES,
        F.row_number().over(oldest_first).alias("week"),
        py_round(predicted).alias("expected_demand"),
    )


def forecast_summary(tail: DataFrame) -> DataFrame:
    """Total, average, peak week (the first of equals) and weeks per series."""
    return tail.groupBy(*SERIES).agg(
        F.sum("expected_demand").alias("total_demand"),
        F.avg("expected_demand").alias("avg_weekly"),
        F.max_by("week", F.struct(F.col("expected_demand"), -F.col("week"))).alias("peak_week"),
        F.max("expected_demand").alias("peak_demand"),
        F.count(F.lit(1)).alias("weeks"),
    )


def dashboard_kpis(history: DataFrame, tail: DataFrame) -> DataFrame:
    """Average error, accuracy and forecast total of each series, as whole numbers.

    Rows with zero demand have no percentage error and do not count for accuracy.
    """
    y, p = F.col(TARGET), F.col("predicted")
    # Cents are summed as integers, so a tie rounds the same in any row order.
    cents = F.sum(whole(F.abs(y - p) * 100.0)).cast("double")
    fit = history.groupBy(*SERIES).agg(
        half_up(cents / (F.count(F.lit(1)) * 100.0)).alias("avg_error"),
        F.coalesce(
            half_up((1.0 - F.avg(ratio(F.abs(y - p), y))) * 100.0), F.lit(0).cast("long")
        ).alias("accuracy"),
    )
    total = tail.groupBy(*SERIES).agg(F.sum("expected_demand").alias("total_demand"))
    return fit.join(total, list(SERIES), "left").select(
        *SERIES,
        "avg_error",
        "accuracy",
        half_up(py_round(F.coalesce("total_demand", F.lit(0.0)))).alias("total_demand"),
    )

"""Stock recommendations for scenarios and for whole stores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import (
    abs_pct_error,
    date_text,
    np_round,
    percent_text,
    py_round,
    week_end,
)
from ..operators.clean import series_semi, store_filter
from ..operators.features import create_features
from ..operators.history import ERROR_ROWS, dated_values
from ..operators.joins import split_join
from ..operators.models import prepare_scenarios
from ..operators.resample import LAST, period_end, shift_back
from ..schema import DATE, LAG_COLUMNS, SERIES, TARGET

# Why a bulk row has no figures.
NO_PREDICTION = "no prediction: unseen label, store without a model, or missing input"

SCENARIO_COLUMNS = (
    "category",
    "region",
    "weather_condition",
    "seasonality",
    "inventory_level",
    "price",
    "discount",
    "competitor_pricing",
    "holiday_promotion",
)


def scored_history(history: DataFrame, forecaster) -> DataFrame:
    """Featured history with ``predicted`` and ``actual``."""
    return forecaster.score_history(create_features(history)).withColumn("actual", F.col(TARGET))


def with_position(scored: DataFrame) -> DataFrame:
    """Place each row by its distance from the series' newest: rows, weeks, months.

    The windows keep the partitioning and the sort the features made.
    """
    series = Window.partitionBy(*SERIES)
    first, last = F.min(DATE).over(series), F.max(DATE).over(series)
    rank = F.row_number().over(series.orderBy(DATE))
    placed = scored.withColumns(
        {
            "recency": F.count(F.lit(1)).over(series) - rank + 1,
            "_first": first,
            "_last": last,
        }
    )
    months = (F.year("_last") - F.year(DATE)) * 12 + F.month("_last") - F.month(DATE)
    weeks = F.date_diff(week_end("_last"), week_end(DATE)) / 7
    return placed.withColumns({"_weeks_back": weeks.cast("int"), "_months_back": months})


def _period_listing(freq: str) -> Column:
    """Means of the last periods of a series, oldest first, as one aggregate.

    A period without rows that lies after the series' first one is listed as
    nulls, as :func:`~shelfcast.operators.resample.resample` does.
    """
    back = F.col("_weeks_back" if freq == "week" else "_months_back")
    oldest, newest = F.min("_first"), F.max("_last")
    entries = []
    for distance in reversed(range(LAST[freq])):
        end = shift_back(freq, period_end(freq, newest), distance)
        entry = F.struct(
            date_text(end).alias("date"),
            np_round(F.avg(F.when(back == distance, F.col("predicted")))).alias("predicted"),
            np_round(F.avg(F.when(back == distance, F.col("actual")))).alias("actual"),
        )
        entries.append(F.when(end >= period_end(freq, oldest), entry))
    return F.array_compact(F.array(*entries))


def series_summary(scored: DataFrame, listings: dict[str, int], periods: bool = False) -> DataFrame:
    """One row per series: recent error, latest row, first category, last values.

    ``listings`` names arrays of the last rows and their lengths; ``periods``
    adds the weekly and monthly means. All of it comes from one aggregate on
    rows that already lie by series.
    """
    columns = [name for name in (*SCENARIO_COLUMNS, *LAG_COLUMNS) if name in scored.columns]
    error = abs_pct_error(F.col("actual"), F.col("predicted"))
    aggregates = [
        F.avg(F.when(F.col("recency") <= ERROR_ROWS, error)).alias("mean_error"),
        F.max_by(F.struct(*columns), DATE).alias("latest"),
        F.min_by("category", DATE).alias("first_category"),
    ]
    for name, length in listings.items():
        kept = F.when(F.col("recency") <= length, dated_values())
        aggregates.append(F.array_sort(F.collect_list(kept)).alias(name))
    if periods:
        aggregates.append(_period_listing("week").alias("last_6_weeks"))
        aggregates.append(_period_listing("month").alias("last_3_months"))
    return with_position(scored).groupBy(*SERIES).agg(*aggregates)


# -- one scenario per row ---------------------------------------------------


def predict_scenarios(
    scenarios: DataFrame, forecaster, lags: str | None = None, latest: DataFrame | None = None
) -> DataFrame:
    """Weekly demand of each scenario row, rounded to cents."""
    prepared = prepare_scenarios(scenarios, lags or forecaster.lags, latest)
    scored = forecaster.score_scenarios(prepared)
    return scored.withColumn("predicted_weekly_demand", py_round("predicted"))


def recommend(
    scenarios: DataFrame, history: DataFrame, forecaster, lags: str | None = None
) -> DataFrame:
    """A full recommendation document for each scenario.

    ``scenarios`` has the series keys, the target ``date`` and the scenario
    columns. Only the series they name are read from ``history``.
    """
    lags = lags or forecaster.lags
    scored = scored_history(series_semi(history, scenarios), forecaster)
    summary = series_summary(scored, {"last_7_days": 7}, periods=True).drop("first_category")
    if lags == "carry":
        carried = [F.col(f"latest.{name}") for name in LAG_COLUMNS]
        scenarios = scenarios.drop(*LAG_COLUMNS)
        summary = summary.select("*", *carried)
    # A scenario without history keeps its document: its prediction and an empty band.
    joined = split_join(scenarios, summary.drop("latest"), SERIES, "left")
    return single_documents(predict_scenarios(joined, forecaster, lags))


def single_documents(df: DataFrame) -> DataFrame:
    """Shape scored scenarios with their series context into documents.

    All comparisons use the prediction and the band as shown, rounded to cents.
    """
    base = df.select(
        *SERIES,
        F.col(DATE),
        F.col("inventory_level").cast("int").alias("stock"),
        F.col("price").cast("double").alias("price"),
        F.col("mean_error"),
        py_round("predicted").alias("demand"),
        rules.band_low(F.col("predicted"), F.col("mean_error")).alias("low"),
        rules.band_high(F.col("predicted"), F.col("mean_error")).alias("high"),
        "last_7_days",
        "last_6_weeks",
        "last_3_months",
    )
    stock, low, demand, high = (F.col(name) for name in ("stock", "low", "demand", "high"))
    band = (stock, low, demand, high)
    factor = rules.WEEKS_PER_MONTH["single"]
    base = base.withColumns(
        {
            "short": rules.shortage(demand, stock),
            "extra": rules.surplus(demand, stock),
            "order": rules.recommended_order(*band),
            "month_low": rules.times(low, factor),
            "month_avg": rules.times(demand, factor),
            "month_high": rules.times(high, factor),
        }
    ).withColumn("lost", rules.money(F.col("short"), F.col("price")))
    short, extra = F.col("short"), F.col("extra")
    return base.select(
        *SERIES,
        date_text(DATE).alias("prediction_for_date"),
        demand.alias("predicted_demand"),
        F.struct(
            stock.alias("current_stock"),
            demand.alias("predicted_sales_this_week"),
            rules.stock_status(*band, profile="single").alias("stock_status"),
            rules.stock_message(*band, extra).alias("message"),
            rules.shopkeeper_text(
                stock, demand, short, extra, F.col("order"), F.col("lost")
            ).alias("simple_explanation"),
            rules.action_needed(*band).alias("action_needed"),
        ).alias("summary"),
        F.struct(
            F.col("order").alias("recommended_order_quantity"),
            py_round(short).alias("shortage_units"),
            py_round(extra).alias("surplus_units"),
            py_round(high - demand).alias("safety_stock_needed"),
        ).alias("stock_recommendation"),
        F.struct(
            F.struct(
                low.alias("low"),
                demand.alias("average"),
                high.alias("high"),
                percent_text(100.0 - F.col("mean_error")).alias("confidence"),
            ).alias("this_week"),
            F.struct(
                F.col("month_low").alias("low"),
                F.col("month_avg").alias("average"),
                F.col("month_high").alias("high"),
                rules.month_text(F.col("month_low"), F.col("month_high")).alias("explanation"),
            ).alias("this_month"),
        ).alias("demand_estimates"),
        F.struct(
            rules.money(demand, F.col("price")).alias("expected_revenue"),
            F.col("lost").alias("potential_lost_revenue"),
            F.lit(rules.CURRENCY).alias("currency"),
        ).alias("financial_impact"),
        F.struct(
            py_round("mean_error").alias("avg_error_percent"),
            low.alias("low"),
            high.alias("high"),
        ).alias("confidence_interval"),
        F.struct(
            *[
                F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
                for name in ("last_7_days", "last_6_weeks", "last_3_months")
            ]
        ).alias("performance_context"),
    )


# -- every product of a store -----------------------------------------------


def bulk_recommend(
    history: DataFrame,
    target_date: str | date,
    forecaster,
    stores: str | DataFrame | None = None,
    lags: str | None = None,
) -> DataFrame:
    """A recommendation for the latest state of each product of each store.

    The panel is shuffled once, by series; history scores, recent error, latest
    row and listing all come from that layout.
    """
    if not target_date:
        raise ValueError("a target date is required")
    if stores is not None:
        history = store_filter(history, stores)
    scored = scored_history(history, forecaster)
    summary = series_summary(scored, {"last_4_weeks": 4})
    scenarios = summary.select(
        *SERIES, "mean_error", "first_category", "last_4_weeks", "latest.*"
    ).withColumn(DATE, F.lit(str(target_date)).cast("date"))
    prepared = prepare_scenarios(scenarios, lags or forecaster.lags)
    return bulk_rows(forecaster.score_scenarios(prepared))


def _horizon(low: Column, average: Column, high: Column, period: str, text: str) -> Column:
    return F.struct(
        low.alias("low"),
        average.alias("average"),
        high.alias("high"),
        F.lit(period).alias("period"),
        F.lit(text).alias("explanation"),
    )


def bulk_rows(df: DataFrame) -> DataFrame:
    """Shape scored latest rows; comparisons use the unrounded prediction."""
    demand, price = F.col("predicted"), F.col("price").cast("double")
    base = df.withColumns(
        {
            "stock": F.col("inventory_level").cast("int"),
            "low": rules.band_low(demand, F.col("mean_error")),
            "high": rules.band_high(demand, F.col("mean_error")),
        }
    )
    stock, low, high = F.col("stock"), F.col("low"), F.col("high")
    band = (stock, low, demand, high)
    short = rules.shortage(demand, stock)
    month, quarter = rules.WEEKS_PER_MONTH["bulk"], float(rules.WEEKS_PER_QUARTER)
    order = rules.recommended_order(*band)
    return base.select(
        "store_id",
        date_text(DATE).alias("prediction_date"),
        "product_id",
        F.col("first_category").alias("category"),
        stock.alias("current_stock"),
        py_round(demand).alias("predicted_demand"),
        low.alias("low_estimate"),
        high.alias("high_estimate"),
        order.alias("recommended_order"),
        py_round(short).alias("shortage"),
        rules.stock_status(*band, profile="bulk").alias("status"),
        rules.stock_priority(*band).alias("priority"),
        percent_text(100.0 - F.col("mean_error")).alias("confidence"),
        price.alias("price"),
        (order * price).alias("order_value"),
        rules.money(demand, price).alias("potential_revenue"),
        rules.money(short, price).alias("lost_revenue_risk"),
        F.when(demand.isNull(), F.lit(NO_PREDICTION)).alias("error"),
        "last_4_weeks",
        F.struct(
            _horizon(
                low, py_round(demand), high, "Next 7 days", "Expected sales for the next week"
            ).alias("weekly"),
            _horizon(
                rules.per_day(low),
                rules.per_day(demand),
                rules.per_day(high),
                "Per day",
                "Average daily sales rate",
            ).alias("daily_average"),
            _horizon(
                rules.times(low, month),
                rules.times(demand, month),
                rules.times(high, month),
                "Next 30 days",
                "Expected sales for the next month",
            ).alias("monthly"),
            _horizon(
                rules.times(low, quarter),
                rules.times(demand, quarter),
                rules.times(high, quarter),
                "Next 90 days (3 months)",
                "Expected sales for the next quarter",
            ).alias("quarterly"),
        ).alias("demand_breakdown"),
    )


def priority_sort(rows: DataFrame) -> DataFrame:
    """Most urgent first within each store.

    A global sort samples its input before it runs. Placing the finished rows,
    one per series, first keeps that sample from computing them twice.
    """
    placed = rows.repartition(*SERIES)
    return placed.orderBy("store_id", "priority", "product_id")


def bulk_summary(rows: DataFrame) -> DataFrame:
    """Products per status, order value and revenue at risk of each store."""
    counts = [
        F.count_if(F.col("status") == status).alias(name)
        for status, name in (
            ("CRITICAL", "critical_stock"),
            ("LOW", "low_stock"),
            ("ADEQUATE", "adequate_stock"),
            ("EXCESS", "excess_stock"),
        )
    ]
    return rows.groupBy("store_id", "prediction_date").agg(
        F.count(F.lit(1)).alias("total_products"),
        *counts,
        F.count_if(F.col("error").isNotNull()).alias("failed_products"),
        py_round(F.sum("order_value")).alias("total_order_value"),
        py_round(F.sum("lost_revenue_risk")).alias("total_revenue_at_risk"),
        F.first(F.lit(rules.CURRENCY)).alias("currency"),
    )


def listing_accuracy(rows: DataFrame) -> DataFrame:
    """Each listed week of each product with its own accuracy."""
    week = F.explode("last_4_weeks").alias("week")
    return rows.select(*SERIES, week).select(
        *SERIES,
        "week.date",
        "week.predicted",
        "week.actual",
        rules.row_accuracy(F.col("week.actual"), F.col("week.predicted")).alias("accuracy"),
    )

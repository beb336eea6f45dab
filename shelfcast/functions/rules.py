"""Decision rules as column expressions: stock policy, demand bands, grades.

Every rule takes and returns columns, so a plan that uses several of them stays
one projection inside one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import float_text, py_round, ratio, whole

# Z factors for the share of weeks without a stock-out.
SERVICE_LEVELS = {"90%": 1.28, "95%": 1.65, "98%": 2.05}

CURRENCY = "₹"
URGENT_BUFFER = 0.2
LOW_BUFFER = 0.15
DAYS_PER_WEEK = 7
WEEKS_PER_QUARTER = 13

# Weeks in a month and the name of the lowest band, by profile.
WEEKS_PER_MONTH = {"single": 4.0, "bulk": 4.33}
CRITICAL_NAME = {"single": "CRITICAL_LOW", "bulk": "CRITICAL"}


# -- stock policy -----------------------------------------------------------


def safety_stock(demand_std: Column, lead_time_weeks: float, service_level: float) -> Column:
    return F.lit(float(service_level)) * demand_std * F.sqrt(F.lit(float(lead_time_weeks)))


def reorder_point(mean_demand: Column, safety: Column, lead_time_weeks: float) -> Column:
    return mean_demand * F.lit(float(lead_time_weeks)) + safety


def order_quantity(point: Column, stock: Column) -> Column:
    return F.rint(F.greatest(point - stock, F.lit(0.0)))


def stockout_risk(point: Column, stock: Column) -> Column:
    return F.when(stock < point, 1).otherwise(0)


# -- demand band and stock status -------------------------------------------


def band_low(predicted: Column, error_pct: Column) -> Column:
    """Lower end of the band; an error over 100 % makes it negative."""
    return py_round(predicted * (F.lit(1.0) - error_pct / 100.0))


def band_high(predicted: Column, error_pct: Column) -> Column:
    return py_round(predicted * (F.lit(1.0) + error_pct / 100.0))


def by_band(
    stock: Column,
    low: Column,
    predicted: Column,
    high: Column,
    critical: Column,
    short: Column,
    enough: Column,
    excess: Column,
) -> Column:
    """Pick a value by the band ``stock`` lies in.

    With a null band (no usable error) only the comparison with ``predicted``
    can hold, so the status comes from that alone. Without a prediction or a
    stock there is nothing to compare: null.
    """
    return (
        F.when(stock.isNull() | predicted.isNull(), F.lit(None))
        .when(stock < low, critical)
        .when(stock < predicted, short)
        .when(stock < high, enough)
        .otherwise(excess)
    )


def stock_status(stock, low, predicted, high, profile: str = "bulk") -> Column:
    return by_band(
        stock,
        low,
        predicted,
        high,
        F.lit(CRITICAL_NAME[profile]),
        F.lit("LOW"),
        F.lit("ADEQUATE"),
        F.lit("EXCESS"),
    )


def stock_priority(stock, low, predicted, high) -> Column:
    return by_band(stock, low, predicted, high, F.lit(1), F.lit(2), F.lit(3), F.lit(4))


def action_needed(stock, low, predicted, high) -> Column:
    return by_band(
        stock,
        low,
        predicted,
        high,
        F.lit("ORDER_IMMEDIATELY"),
        F.lit("ORDER_SOON"),
        F.lit("MONITOR"),
        F.lit("NO_ORDER_NEEDED"),
    )


def recommended_order(stock, low, predicted, high) -> Column:
    return by_band(
        stock,
        low,
        predicted,
        high,
        whole(high - stock + high * URGENT_BUFFER),
        whole(predicted - stock + predicted * LOW_BUFFER),
        whole(F.greatest(high - stock, F.lit(0.0))),
        F.lit(0).cast("long"),
    )


def shortage(predicted: Column, stock: Column) -> Column:
    return F.when(predicted.isNotNull() & stock.isNotNull(), F.greatest(predicted - stock, F.lit(0.0)))


def surplus(predicted: Column, stock: Column) -> Column:
    return F.when(predicted.isNotNull() & stock.isNotNull(), F.greatest(stock - predicted, F.lit(0.0)))


def times(value: Column, factor: float) -> Column:
    return py_round(value * F.lit(float(factor)))


def per_day(value: Column) -> Column:
    return py_round(value / F.lit(float(DAYS_PER_WEEK)))


def money(units: Column, price: Column) -> Column:
    return py_round(units * price)


def row_accuracy(actual: Column, predicted: Column) -> Column:
    """100 minus the percentage error of one row; null unless demand is positive."""
    return F.when(actual > 0, (F.lit(1.0) - ratio(F.abs(predicted - actual), actual)) * 100.0)


# -- texts ------------------------------------------------------------------


def stock_message(stock, low, predicted, high, extra) -> Column:
    """Fixed texts: the status line shown beside a recommendation."""
    have = stock.cast("string")
    return by_band(
        stock,
        low,
        predicted,
        high,
        F.concat(
            F.lit("⚠️ URGENT: Stock critically low! You have "),
            have,
            F.lit(" units but need at least "),
            float_text(low),
            F.lit(" units."),
        ),
        F.concat(
            F.lit("⚡ Stock is low. You have "),
            have,
            F.lit(" units but predicted demand is "),
            float_text(predicted),
            F.lit(" units."),
        ),
        F.concat(
            F.lit("✅ Stock is adequate. You have "),
            have,
            F.lit(" units for predicted demand of "),
            float_text(predicted),
            F.lit(" units."),
        ),
        F.concat(
            F.lit("📦 Stock is high. You have "),
            have,
            F.lit(" units, which is "),
            float_text(extra),
            F.lit(" units more than predicted demand."),
        ),
    )


def shopkeeper_text(stock, predicted, short, extra, order, lost) -> Column:
    """Fixed texts: the plain-language explanation of a recommendation."""
    opening = F.concat(
        F.lit("You currently have "),
        stock.cast("string"),
        F.lit(" units in stock. Based on past sales, you will likely sell "),
        float_text(predicted),
        F.lit(" units this week. "),
    )
    ending = (
        F.when(
            short > 0,
            F.concat(
                F.lit("This means you are SHORT by "),
                float_text(py_round(short)),
                F.lit(" units. Order at least "),
                order.cast("string"),
                F.lit(f" units to avoid losing {CURRENCY}"),
                float_text(lost),
                F.lit(" in sales."),
            ),
        )
        .when(
            extra > 0,
            F.concat(
                F.lit("You have EXTRA "),
                float_text(py_round(extra)),
                F.lit(" units, which is good for safety stock."),
            ),
        )
        .otherwise(F.lit("Your stock level is PERFECT for this week's demand."))
    )
    return F.concat(opening, ending)


def month_text(low: Column, high: Column) -> Column:
    """Fixed text: the monthly range."""
    return F.concat(
        F.lit("Based on 4 weeks, you will sell between "),
        float_text(low),
        F.lit(" to "),
        float_text(high),
        F.lit(" units this month"),
    )


# -- grades -----------------------------------------------------------------


def quality_grade(accuracy: Column) -> Column:
    return (
        F.when(accuracy >= 90, "EXCELLENT")
        .when(accuracy >= 80, "GOOD")
        .when(accuracy >= 70, "MODERATE")
        .otherwise("POOR")
    )


def generalization_grade(mean_gap: Column) -> Column:
    return (
        F.when(mean_gap < 2, "EXCELLENT")
        .when(mean_gap < 5, "GOOD")
        .when(mean_gap < 10, "MODERATE")
        .otherwise("POOR")
    )


def recommended_metric(zero_percentage: Column) -> Column:
    return (
        F.when(zero_percentage > 20, "WAPE")
        .when(zero_percentage > 5, "SMAPE")
        .otherwise("MAPE")
    )


def drift_status(change: Column) -> Column:
    return (
        F.when(F.abs(change) < 5, "CONSISTENT").when(change > 0, "IMPROVED").otherwise("DEGRADED")
    )

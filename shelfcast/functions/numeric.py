"""Column expressions for rounding, logs, ratios, dates and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2^27 + 1 splits a double into two halves whose products are exact.
SPLITTER = 134217729.0


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where ``bottom`` is zero."""
    return top / F.nullif(bottom, F.lit(0.0))


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def py_round(value: Column | str, digits: int = 2) -> Column:
    """Round like Python's ``round(float, digits)``: by exact value, ties to even.

    ``round`` and ``bround`` look at the printed decimals, so 2.675 would become
    2.68 although its binary value lies below the tie. The scaled product is at
    an apparent tie only there; its rounding error then tells the true side.
    """
    x = as_column(value).cast("double")
    scale = F.lit(float(10**digits))
    scaled = x * scale
    split = x * F.lit(SPLITTER)
    high = split - (split - x)
    residue = (high * scale - scaled) + (x - high) * scale
    below = F.floor(scaled).cast("double")
    units = F.when(
        scaled - below == 0.5,
        F.when(residue > 0, below + 1.0).when(residue < 0, below).otherwise(F.rint(scaled)),
    ).otherwise(F.rint(scaled))
    return units / scale


def np_round(value: Column | str, digits: int = 2) -> Column:
    """Round like a pandas column: scale, nearest even integer, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(as_column(value).cast("double") * scale) / scale


def whole(value: Column) -> Column:
    """Nearest integer, ties to even, as a long."""
    return F.rint(value).cast("long")


def half_up(value: Column) -> Column:
    """Nearest integer, ties upwards, as the dashboard shows its figures."""
    return F.floor(value + 0.5).cast("long")


def float_text(value: Column) -> Column:
    """A float as plain text with at least one decimal, without an exponent."""
    plain = (F.abs(value) < 1e7) & ((F.abs(value) >= 1e-3) | (value == 0))
    decimals = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0{1,5}$", "")
    return F.when(plain, value.cast("string")).otherwise(decimals)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", py_round(value, digits))


def log_target(value: Column | str) -> Column:
    return F.log1p(as_column(value))


def unlog(value: Column | str) -> Column:
    return F.expm1(as_column(value))


def iso_week(date: Column | str) -> Column:
    return F.weekofyear(as_column(date))


def month_number(date: Column | str) -> Column:
    return F.month(as_column(date))


def weekend_flag(date: Column | str) -> Column:
    return F.when(F.weekday(as_column(date)).isin(5, 6), 1).otherwise(0)


def date_text(date: Column | str) -> Column:
    return F.date_format(as_column(date), "yyyy-MM-dd")


def month_key(date: Column | str) -> Column:
    return F.date_format(as_column(date), "yyyy-MM")


def week_end(date: Column | str) -> Column:
    """The Sunday that closes the week of ``date``."""
    return F.date_add(F.trunc(as_column(date), "week"), 6)


def month_end(date: Column | str) -> Column:
    return F.last_day(as_column(date))


def abs_pct_error(actual: Column, predicted: Column) -> Column:
    """|predicted - actual| / actual in percent, null for a zero actual."""
    return ratio(F.abs(predicted - actual), actual) * 100.0

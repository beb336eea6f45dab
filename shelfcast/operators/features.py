"""Trailing demand, lags, rolling means and calendar columns per series.

All windows share one partitioning and one order, so they cost one exchange and
one sort. They count rows, not days: gaps in a series are not filled.

A panel has one row per series and date (``upsert_keep_last`` keeps it so and
``check_unique`` proves it), so a series is at most as long as the calendar: a
century is 36,525 rows, whatever share of the panel the series holds. For input
without that bound, pass ``segment_rows``: series are then cut into segments
that carry the rows their first windows look back on (see ``segments``), with
the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import iso_week, log_target, month_number, weekend_flag
from ..schema import DATE, LABEL, LAGS, ROLLING_MEANS, SERIES, TARGET
from ..session import durable
from .joins import split_join
from .ordering import segments

DEMAND_ROWS = 7
# lag_60 of a 7-row sum, read one row later by the baseline forecast.
LOOKBACK = max(LAGS) + DEMAND_ROWS + 1


def series_window(keys: Sequence[str] = SERIES, order: str = DATE) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(window: WindowSpec, rows: int) -> WindowSpec:
    return window.rowsBetween(-(rows - 1), 0)


def rolling_demand(df: DataFrame, window: WindowSpec | None = None) -> DataFrame:
    """``units_sold_7d``: units sold on this and the six preceding rows."""
    window = window or series_window()
    total = F.sum("units_sold").over(trailing(window, DEMAND_ROWS))
    return df.withColumn(TARGET, total.cast("double"))


def lag_features(df: DataFrame, window: WindowSpec | None = None) -> DataFrame:
    window = window or series_window()
    return df.withColumns(
        {f"lag_{n}": F.coalesce(F.lag(TARGET, n).over(window), F.lit(0.0)) for n in LAGS}
    )


def rolling_means(df: DataFrame, window: WindowSpec | None = None) -> DataFrame:
    window = window or series_window()
    return df.withColumns(
        {f"rolling_mean_{n}": F.avg(TARGET).over(trailing(window, n)) for n in ROLLING_MEANS}
    )


def calendar_features(df: DataFrame, date: str = DATE) -> DataFrame:
    return df.withColumns(
        {"week": iso_week(date), "month": month_number(date), "is_weekend": weekend_flag(date)}
    )


def naive_diff(df: DataFrame, value: str = TARGET, window: WindowSpec | None = None) -> DataFrame:
    """First difference of ``value`` along the series; null on its first row."""
    window = window or series_window()
    return df.withColumn("naive_diff", F.col(value) - F.lag(value, 1).over(window))


def _all_features(df: DataFrame, window: WindowSpec) -> DataFrame:
    df = rolling_demand(df, window).withColumn(LABEL, log_target(TARGET))
    return rolling_means(lag_features(calendar_features(df), window), window)


def _baseline(df: DataFrame, window: WindowSpec) -> DataFrame:
    previous = F.lag("rolling_mean_7", 1).over(window)
    return df.withColumn("predicted", F.coalesce(previous, F.lit(0.0)))


def _along_series(
    df: DataFrame,
    step: Callable[[DataFrame, WindowSpec], DataFrame],
    segment_rows: int | None,
    tie_break: Sequence[str],
) -> DataFrame:
    if segment_rows is None:
        return step(df, Window.partitionBy(*SERIES).orderBy(DATE, *tie_break))
    cut = segments(df, SERIES, [DATE, *tie_break], LOOKBACK, segment_rows)
    window = Window.partitionBy(*SERIES, "_segment").orderBy("_place")
    return step(cut, window).filter(~F.col("_halo")).drop("_segment", "_place", "_halo")


def create_features(
    df: DataFrame, segment_rows: int | None = None, tie_break: Sequence[str] = ()
) -> DataFrame:
    """All features of the demand model and its label, for every series at once.

    ``tie_break`` names columns that order rows of the same series and date.
    Note that the target and the rolling means include the current row.
    """
    return _along_series(df, _all_features, segment_rows, tie_break)


def baseline_predict(df: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """``predicted``: the rolling mean known before this row, 0 on the first.

    Takes the output of :func:`create_features` and adds no exchange to it.
    """
    return _baseline(df, Window.partitionBy(*SERIES).orderBy(DATE, *tie_break))


def features_with_baseline(
    df: DataFrame, segment_rows: int | None = None, tie_break: Sequence[str] = ()
) -> DataFrame:
    """:func:`create_features` and :func:`baseline_predict` in one pass."""

    def both(rows: DataFrame, window: WindowSpec) -> DataFrame:
        return _baseline(_all_features(rows, window), window)

    return _along_series(df, both, segment_rows, tie_break)


# -- features of new rows without the whole history ---------------------------


def feature_state(panel: DataFrame) -> DataFrame:
    """The last ``LOOKBACK`` rows of each series: all that features of later rows look back on."""
    order = Window.partitionBy(*SERIES).orderBy(F.col(DATE).desc())
    return panel.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= LOOKBACK).drop("_back")


def update_features(state: DataFrame, batch: DataFrame, panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features after a batch, and the state after it.

    Gives the features of every row from its series' first row in the batch on.
    ``state`` is :func:`feature_state` of ``panel``, the panel before the batch, and
    ``batch`` has one row per key. Series whose batch rows all lie behind their state
    need the state only, and if all do, the panel is not read. Rows at or before the end of
    their series' state replace or precede known rows; only such series are then
    taken from the panel. Columns of the state that the batch lacks are null in its rows.
    """
    batch = batch.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in state.columns])
    ends = state.groupBy(*SERIES).agg(F.max(DATE).alias("_last"))
    firsts = batch.groupBy(*SERIES).agg(F.min(DATE).alias("_first"))
    late = F.coalesce(F.col("_first") <= F.col("_last"), F.lit(False))
    touched = durable(firsts.join(ends, list(SERIES), "left").select(*SERIES, "_first", late.alias("_late")))
    fresh, behind = touched.filter(~F.col("_late")), touched.filter(F.col("_late"))
    old = split_join(state, fresh, SERIES)
    if not behind.isEmpty():
        replaced = batch.select(*SERIES, DATE).withColumn("_replaced", F.lit(True))
        known = split_join(split_join(panel.select(*state.columns), behind, SERIES), replaced, (*SERIES, DATE), "left")
        old = old.unionByName(known.filter(F.col("_replaced").isNull()).drop("_replaced"))
    merged = old.unionByName(split_join(batch, touched, SERIES))
    features = create_features(merged).filter(F.col(DATE) >= F.col("_first")).drop("_first", "_late")
    untouched = state.join(touched.select(*SERIES), list(SERIES), "left_anti")
    return features, feature_state(merged.drop("_first", "_late").unionByName(untouched))

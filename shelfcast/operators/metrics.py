"""Forecast accuracy: one aggregate pass for all metrics, overall or per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp_percent, month_key, ratio
from ..functions.rules import (
    drift_status,
    generalization_grade,
    quality_grade,
    recommended_metric,
)
from ..schema import DATE, SERIES, TARGET
from ..session import durable
from .ordering import adjacent_gaps
from .quantiles import exact_percentiles

TOLERANCES = (10, 20, 30)
LAST_MONTHS = 6


def error_columns(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    return df.withColumns(
        {
            "error": error,
            "abs_error": F.abs(error),
            "pct_error": ratio(error, F.col(actual)) * 100.0,
        }
    )


def _group(df: DataFrame, by: Sequence[str] | None, aggregates: Sequence[Column]) -> DataFrame:
    return df.groupBy(*(by or ())).agg(*aggregates)


def _raw_aggregates(y: Column, p: Column, exclude_zeros: bool) -> list[Column]:
    gap = F.abs(p - y)
    mape = F.avg(ratio(gap, F.abs(y))) * 100.0
    if not exclude_zeros:
        # A zero actual makes the mean infinite, which counts as no result.
        mape = F.when(F.count_if(y == 0) == 0, mape)
    zeros = F.count_if(y == 0)
    rows = F.count(F.lit(1))
    return [
        F.avg(gap).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.sum(gap * gap).alias("_sse"),
        (F.var_pop(y) * rows).alias("_sst"),
        F.coalesce(mape, F.lit(0.0)).alias("mape"),
        F.coalesce(100.0 * F.avg(ratio(gap, F.abs(y) + F.abs(p))), F.lit(0.0)).alias("smape"),
        F.coalesce(ratio(100.0 * F.sum(gap), F.sum(F.abs(y))), F.lit(0.0)).alias("wape"),
        rows.alias("total_records"),
        zeros.alias("zero_records"),
        (rows - zeros if exclude_zeros else rows).alias("mape_records"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
        F.stddev_pop(y).alias("std_actual"),
        F.stddev_pop(p).alias("std_predicted"),
        F.min(y).alias("min_actual"),
        F.max(y).alias("max_actual"),
        F.min(p).alias("min_predicted"),
        F.max(p).alias("max_predicted"),
    ]


def r2_column(sse: Column, sst: Column, rows: Column) -> Column:
    """1 - SSE/SST; a constant actual gives 1 if hit exactly, else 0; null for one row."""
    constant = F.when(sse == 0, 1.0).otherwise(0.0)
    return F.when(rows >= 2, F.coalesce(1.0 - ratio(sse, sst), constant))


# The order metrics are reported in.
METRIC_COLUMNS = (
    "mae",
    "rmse",
    "r2",
    "mape",
    "smape",
    "wape",
    "mase",
    "mape_accuracy",
    "smape_accuracy",
    "wape_accuracy",
    "total_records",
    "zero_records",
    "zero_percentage",
    "mape_records",
    "mean_actual",
    "mean_predicted",
    "std_actual",
    "std_predicted",
    "min_actual",
    "max_actual",
    "min_predicted",
    "max_predicted",
)


def all_metrics(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] | None = None,
    train: DataFrame | None = None,
    exclude_zeros: bool = True,
    mase_scope: str = "pooled",
) -> DataFrame:
    """Every accuracy metric, as one row or one row per group.

    ``train`` (with column ``actual``) scales MASE, which is null without it.
    """
    by = list(by or ())
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    raw = _group(df, by, _raw_aggregates(y, p, exclude_zeros))
    mase = F.lit(None).cast("double")
    if train is not None:
        naive = naive_error(train, actual, by, mase_scope)
        raw = _attach(raw, naive, by)
        scale = ratio(F.col("gap_sum"), F.col("gap_count").cast("double"))
        scaled = F.coalesce(ratio(F.col("mae"), scale), F.lit(0.0))
        usable = F.coalesce(F.col("gap_count"), F.lit(0)) > 0
        mase = F.when(usable, scaled).otherwise(F.col("mae"))
    return _finished(raw, mase).select(*by, *METRIC_COLUMNS)


def _finished(raw: DataFrame, mase: Column) -> DataFrame:
    """Raw aggregates with the metrics that follow from them."""
    return raw.withColumns(
        {
            "r2": r2_column(F.col("_sse"), F.col("_sst"), F.col("total_records")),
            "mase": mase,
            "zero_percentage": F.coalesce(
                ratio(F.col("zero_records") * 100.0, F.col("total_records").cast("double")),
                F.lit(0.0),
            ),
            **{
                f"{name}_accuracy": clamp_percent(100.0 - F.col(name))
                for name in ("mape", "smape", "wape")
            },
        }
    )


def metrics_in_one_pass(
    df: DataFrame,
    sections: Mapping[str, Sequence[str]],
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """The metrics of several groupings from one scan and one shuffle of the rows.

    ``sections`` maps a name to the columns it groups by, none for all rows. The result has a
    row per section and group: ``section``, every grouping column (null
    where the section does not group by it) and the metrics; MASE is null. It
    has one row per group and is pinned, so sections are cheap filters on it. Without
    rows there is no group, and no row for the section of all rows either.
    """
    keys = list(dict.fromkeys(name for by in sections.values() for name in by))
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rows = df.select(*keys, y.alias("_y"), p.alias("_p"))
    sets = [[F.col(name) for name in by] for by in sections.values()]
    grouped = rows.groupingSets(sets, *[F.col(name) for name in keys]).agg(
        F.grouping_id().alias("_set"), *_raw_aggregates(F.col("_y"), F.col("_p"), True)
    )
    # A bit per grouping column, the first one highest, set where the section does not group by it.
    number = {name: sum(1 << len(keys) - 1 - k for k, key in enumerate(keys) if key not in by) for name, by in sections.items()}
    section = F.coalesce(*[F.when(F.col("_set") == bits, name) for name, bits in number.items()])
    full = _finished(grouped, F.lit(None).cast("double"))
    return durable(full.select(section.alias("section"), *keys, *METRIC_COLUMNS))


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on ``by``; without groups both sides are a single row."""
    if by:
        return left.join(right, list(by), "left")
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(right.select("*", one), "_one", "left").drop("_one")


def naive_error(
    train: DataFrame,
    value: str = TARGET,
    by: Sequence[str] | None = None,
    scope: str = "pooled",
) -> DataFrame:
    """Sum and count of the one-step naive forecast's absolute errors.

    ``pooled`` runs over the rows in (store, product, date) order and so also
    counts the steps from the end of one series to the start of the next;
    ``series`` leaves those out. Steps inside a series reuse the feature
    partitioning, also where groups cut across series. All that a group's rows of
    a series add are four numbers - the first and last value, the sum and the
    count of steps - which the steps between series then close.
    """
    by = list(by or ())
    keys = list(dict.fromkeys([*by, *SERIES]))
    window = Window.partitionBy(*keys).orderBy(DATE)
    step = F.abs(F.col(value) - F.lag(value, 1).over(window))
    per_series = train.withColumn("_step", step).groupBy(*keys).agg(
        F.sum("_step").alias("_sum"),
        F.count("_step").alias("_count"),
        F.min_by(value, DATE).alias("_first"),
        F.max_by(value, DATE).alias("_last"),
    )
    if scope != "series":
        # Read twice below: one row per group and series instead of the panel.
        per_series = durable(per_series)
    inside = per_series.groupBy(*by).agg(
        F.coalesce(F.sum("_sum"), F.lit(0.0)).alias("gap_sum"),
        F.sum("_count").alias("gap_count"),
    )
    if scope == "series":
        return inside
    between = adjacent_gaps(per_series, list(SERIES), "_first", "_last", by)
    renamed = between.select(
        *by, F.col("gap_sum").alias("_between_sum"), F.col("gap_count").alias("_between_count")
    )
    return _attach(inside, renamed, by).select(
        *by,
        (F.col("gap_sum") + F.coalesce("_between_sum", F.lit(0.0))).alias("gap_sum"),
        (F.col("gap_count") + F.coalesce("_between_count", F.lit(0))).alias("gap_count"),
    )


# -- reports by group -------------------------------------------------------


def group_accuracy(
    df: DataFrame,
    by: Sequence[str],
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """Records, zeros, accuracies, MAE and R² per group.

    ``accuracy`` is 100 - MAPE without the clamp, so it may be negative.
    """
    return accuracy_of(all_metrics(df, actual, predicted, by), by)


def accuracy_of(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """The columns of a report by group from all metrics of its groups."""
    return metrics.select(
        *by,
        F.col("total_records").alias("records"),
        "zero_records",
        "zero_percentage",
        "wape_accuracy",
        "smape_accuracy",
        "mape_accuracy",
        (100.0 - F.col("mape")).alias("accuracy"),
        "mae",
        "r2",
        quality_grade(100.0 - F.col("mape")).alias("grade"),
    )


def metrics_by_store(df: DataFrame, **names: str) -> DataFrame:
    return store_section(group_accuracy(df, ["store_id"], **names))


def store_section(report: DataFrame) -> DataFrame:
    return report.orderBy("store_id")


def metrics_by_category(df: DataFrame, **names: str) -> DataFrame:
    return category_section(group_accuracy(df, ["category"], **names))


def category_section(report: DataFrame) -> DataFrame:
    return report.select("category", "records", "accuracy", "mae", "grade").orderBy("category")


def metrics_by_month(df: DataFrame, last: int = LAST_MONTHS, **names: str) -> DataFrame:
    """Accuracy per calendar month, for the latest ``last`` months that have rows."""
    return month_section(group_accuracy(df.withColumn("period", month_key(DATE)), ["period"], **names), last)


def month_section(report: DataFrame, last: int = LAST_MONTHS) -> DataFrame:
    latest = report.orderBy(F.col("period").desc()).limit(last)
    return latest.select("period", "records", "accuracy", "mae").orderBy("period")


# -- error analysis ---------------------------------------------------------


def error_distribution(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] | None = None,
) -> DataFrame:
    by = list(by or ())
    errors = df.select(*by, (F.col(predicted) - F.col(actual)).alias("_error"))
    summary = _group(
        errors,
        by,
        [
            F.avg("_error").alias("mean_error"),
            F.stddev_samp("_error").alias("std_error"),
            F.min("_error").alias("min_error"),
            F.max("_error").alias("max_error"),
        ],
    )
    median = exact_percentiles(errors, "_error", {"median_error": 0.5}, by)
    return _attach(summary, median, by).select(
        *by, "mean_error", "median_error", "std_error", "min_error", "max_error"
    )


def error_percentiles(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Exact 25th, 50th, 75th and 95th percentile of the absolute error."""
    by = list(by or ())
    errors = df.select(*by, F.abs(F.col(predicted) - F.col(actual)).alias("_error"))
    return exact_percentiles(
        errors, "_error", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, by
    )


def within_tolerance(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Rows, and their share of all rows, whose error is at most 10, 20, 30 %."""
    y = F.col(actual)
    error = F.abs(F.col(predicted) - y)
    rows = F.count(F.lit(1))
    columns = [rows.alias("total_records")]
    for tolerance in TOLERANCES:
        # A zero actual never counts: its relative error is infinite or undefined.
        hits = F.count_if((y != 0) & (ratio(error, y) <= tolerance / 100.0))
        columns.append(hits.alias(f"within_{tolerance}pct"))
        columns.append(ratio(hits * 100.0, rows.cast("double")).alias(f"share_{tolerance}pct"))
    return _group(df, by, columns)


def target_describe(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum."""
    summary = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_percentiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return _attach(summary, quartiles, ()).select(
        "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def prediction_stats(
    df: DataFrame,
    actual: str = "actual",
    predicted: str = "predicted",
    by: Sequence[str] | None = None,
) -> DataFrame:
    columns = [name for name in METRIC_COLUMNS if name.split("_")[0] in {"mean", "std", "min", "max"}]
    return all_metrics(df, actual, predicted, by).select(*(by or ()), *columns)


def store_accuracy(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """(1 - MAE / mean actual) in percent per store, with its rows and MAE."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(F.abs(p - y)).alias("mae"),
        ((1.0 - ratio(F.avg(F.abs(p - y)), F.avg(y))) * 100.0).alias("accuracy"),
    )


# -- assessments ------------------------------------------------------------


def assessment(metrics: DataFrame) -> DataFrame:
    """Metrics with the quality grade (by WAPE accuracy) and the advised metric."""
    return metrics.withColumns(
        {
            "quality_grade": quality_grade(F.col("wape_accuracy")),
            "recommended_metric": recommended_metric(F.col("zero_percentage")),
        }
    )


COMPARED = ("mape_accuracy", "smape_accuracy", "wape_accuracy", "mae", "rmse", "r2")


def generalization_gap(train: DataFrame, valid: DataFrame) -> DataFrame:
    """Validation minus training, per metric, and the grade of the mean gap.

    Both sides are one-row metric frames.
    """
    left = train.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_t_{c}") for c in COMPARED])
    right = valid.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_v_{c}") for c in COMPARED])
    gaps = left.join(right, "_one").select(
        *[(F.col(f"_v_{c}") - F.col(f"_t_{c}")).alias(f"{c}_gap") for c in COMPARED]
    )
    mean_gap = (
        F.abs("mape_accuracy_gap") + F.abs("smape_accuracy_gap") + F.abs("wape_accuracy_gap")
    ) / 3.0
    return gaps.withColumn("mean_gap", mean_gap).withColumn(
        "generalization", generalization_grade(F.col("mean_gap"))
    )


def drift(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Current accuracy against the saved validation accuracy (both one row)."""
    left = current.select(F.lit(1).alias("_one"), "wape_accuracy", "mape_accuracy")
    right = saved.select(F.lit(1).alias("_one"), "valid_wape_accuracy", "valid_mape_accuracy")
    return left.join(right, "_one").select(
        "wape_accuracy",
        "valid_wape_accuracy",
        (F.col("wape_accuracy") - F.col("valid_wape_accuracy")).alias("wape_change"),
        drift_status(F.col("wape_accuracy") - F.col("valid_wape_accuracy")).alias("wape_status"),
        "mape_accuracy",
        "valid_mape_accuracy",
        (F.col("mape_accuracy") - F.col("valid_mape_accuracy")).alias("mape_change"),
        drift_status(F.col("mape_accuracy") - F.col("valid_mape_accuracy")).alias("mape_status"),
    )

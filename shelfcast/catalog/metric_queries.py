"""Accuracy, error analysis and evaluation queries on the baseline forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.models import BaselineForecaster
from ..plans.evaluation import evaluation_sections, report_metrics
from ..plans.reorder import reorder_report
from ..plans.training import split_metrics, training_record
from ..schema import SERIES
from . import fixtures
from .oracle import POOLED_NAIVE, SERIES_NAIVE, S, metrics_sql, r6, with_parts
from .registry import query, rounded


@query("all_metrics", with_parts("pred", metrics_sql("pred")))
def all_metrics(spark, sf_dir):
    return rounded(metrics.all_metrics(fixtures.panel_pred(spark, sf_dir)))


@query(
    "valid_metrics_mase_pooled",
    with_parts(
        "split",
        metrics_sql("(SELECT * FROM split WHERE split = 'valid') v", train=POOLED_NAIVE),
    ),
)
def valid_metrics_mase_pooled(spark, sf_dir):
    split = fixtures.panel_split(spark, sf_dir)
    valid, train = split.filter("split = 'valid'"), split.filter("split = 'train'")
    return rounded(metrics.all_metrics(valid, train=train))


@query(
    "valid_metrics_mase_series",
    with_parts(
        "split",
        metrics_sql("(SELECT * FROM split WHERE split = 'valid') v", train=SERIES_NAIVE),
    ),
)
def valid_metrics_mase_series(spark, sf_dir):
    split = fixtures.panel_split(spark, sf_dir)
    valid, train = split.filter("split = 'valid'"), split.filter("split = 'train'")
    return rounded(metrics.all_metrics(valid, train=train, mase_scope="series"))


@query(
    "mase_by_store",
    with_parts(
        "split",
        f"""
SELECT v.store_id, {r6('coalesce(v.mae / nullif(n.naive, 0), 0)', 'mase')} FROM
 (SELECT store_id, avg(abs(predicted - actual)) AS mae FROM split WHERE split = 'valid' GROUP BY store_id) v
 JOIN (SELECT store_id, avg(d) AS naive FROM (
   SELECT store_id, abs(actual - lag(actual) OVER (PARTITION BY store_id ORDER BY product_id, date)) AS d
   FROM split WHERE split = 'train') GROUP BY store_id) n USING (store_id)""",
    ),
)
def mase_by_store(spark, sf_dir):
    split = fixtures.panel_split(spark, sf_dir)
    valid, train = split.filter("split = 'valid'"), split.filter("split = 'train'")
    report = metrics.all_metrics(valid, by=["store_id"], train=train)
    return rounded(report.select("store_id", "mase"))


@query(
    "mase_by_category",
    with_parts(
        "split",
        f"""
SELECT v.category, {r6('coalesce(v.mae / nullif(n.naive, 0), 0)', 'mase')} FROM
 (SELECT category, avg(abs(predicted - actual)) AS mae FROM split WHERE split = 'valid' GROUP BY category) v
 JOIN (SELECT category, avg(d) AS naive FROM (
   SELECT category, abs(actual - lag(actual) OVER (PARTITION BY category ORDER BY {S}, date)) AS d
   FROM split WHERE split = 'train') GROUP BY category) n USING (category)""",
    ),
)
def mase_by_category(spark, sf_dir):
    split = fixtures.panel_split(spark, sf_dir)
    valid, train = split.filter("split = 'valid'"), split.filter("split = 'train'")
    report = metrics.all_metrics(valid, by=["category"], train=train)
    return rounded(report.select("category", "mase"))


ACCURACY = f"""
  count(*) AS records,
  CAST(count(*) FILTER (WHERE actual = 0) AS BIGINT) AS zero_records,
  {r6('count(*) FILTER (WHERE actual = 0) * 100.0 / count(*)', 'zero_percentage')},
  {r6('greatest(0, least(100, 100 - 100 * sum(abs(predicted - actual)) / sum(abs(actual))))', 'wape_accuracy')},
  {r6('greatest(0, least(100, 100 - 100 * avg(abs(predicted - actual) / nullif(abs(actual) + abs(predicted), 0))))', 'smape_accuracy')},
  {r6('greatest(0, least(100, 100 - 100 * avg(abs(predicted - actual) / nullif(actual, 0))))', 'mape_accuracy')},
  {r6('100 - 100 * avg(abs(predicted - actual) / nullif(actual, 0))', 'accuracy')},
  {r6('avg(abs(predicted - actual))', 'mae')},
  {r6('1 - sum((predicted - actual) * (predicted - actual)) / (var_pop(actual) * count(*))', 'r2')}"""
GRADE = (
    "CASE WHEN accuracy >= 90 THEN 'EXCELLENT' WHEN accuracy >= 80 THEN 'GOOD' "
    "WHEN accuracy >= 70 THEN 'MODERATE' ELSE 'POOR' END AS grade"
)


@query(
    "metrics_by_store",
    with_parts(
        "pred",
        f"SELECT *, {GRADE} FROM (SELECT store_id, {ACCURACY} FROM pred GROUP BY store_id)",
    ),
)
def metrics_by_store(spark, sf_dir):
    return rounded(metrics.metrics_by_store(fixtures.panel_pred(spark, sf_dir)))


@query(
    "metrics_by_category",
    with_parts(
        "pred",
        f"""SELECT category, records, accuracy, mae, {GRADE}
        FROM (SELECT category, {ACCURACY} FROM pred GROUP BY category)""",
    ),
)
def metrics_by_category(spark, sf_dir):
    return rounded(metrics.metrics_by_category(fixtures.panel_pred(spark, sf_dir)))


@query(
    "metrics_by_month",
    with_parts(
        "pred",
        f"""SELECT period, records, accuracy, mae FROM (
          SELECT strftime(date, '%Y-%m') AS period, {ACCURACY} FROM pred GROUP BY 1)
        ORDER BY period DESC LIMIT 6""",
    ),
)
def metrics_by_month(spark, sf_dir):
    return rounded(metrics.metrics_by_month(fixtures.panel_pred(spark, sf_dir)))


SECTION_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS section, {label} AS label, {ACCURACY} FROM pred {group}"
    for name, label, group in (
        ("overall", "CAST(NULL AS VARCHAR)", ""),
        ("by_store", "store_id", "GROUP BY store_id"),
        ("by_category", "category", "GROUP BY category"),
        ("by_month", "strftime(date, '%Y-%m')", "GROUP BY strftime(date, '%Y-%m')"),
    )
)


@query("evaluation_sections", with_parts("pred", f"SELECT *, {GRADE} FROM ({SECTION_SQL})"))
def report_sections(spark, sf_dir):
    """Accuracy overall, by store, by category and by month from one pass."""
    passed = report_metrics(fixtures.panel_pred(spark, sf_dir))
    label = F.coalesce("store_id", "category", "period").alias("label")
    return rounded(metrics.accuracy_of(passed.select("*", label), ["section", "label"]))


@query(
    "reorder_report_metrics",
    with_parts("pred", f"""SELECT *, {GRADE} FROM ({SECTION_SQL}) WHERE section IN ('overall', 'by_store')"""),
)
def reorder_report_metrics(spark, sf_dir):
    """Accuracy overall and by store as the reorder report has it: cleaned, featured and scored rows."""
    report = reorder_report(fixtures.retail_panel(spark, sf_dir), BaselineForecaster())
    every = report["metrics"].withColumn("store_id", F.lit(None).cast("string"))
    every = metrics.accuracy_of(every, ["store_id"]).select(F.lit("overall").alias("section"), "*")
    stores = report["by_store"].select(F.lit("by_store").alias("section"), "*")
    return rounded(every.unionByName(stores).withColumnRenamed("store_id", "label"))


# -- single metrics ---------------------------------------------------------


def _one(name: str, columns: list[str], expression: str):
    @query(name, with_parts("pred", f"SELECT {expression} FROM pred"))
    def run(spark, sf_dir):
        return rounded(metrics.all_metrics(fixtures.panel_pred(spark, sf_dir)).select(*columns))

    return run


_one("mae", ["mae"], r6("avg(abs(actual - predicted))", "mae"))
_one("rmse", ["rmse"], r6("sqrt(avg((actual - predicted) ** 2))", "rmse"))
_one(
    "r2",
    ["r2"],
    r6("1 - sum((actual - predicted) ** 2) / sum((actual - (SELECT avg(actual) FROM pred)) ** 2)", "r2"),
)
_one(
    "mape",
    ["mape", "mape_records"],
    r6("100 * avg(abs(actual - predicted) / actual) FILTER (WHERE actual <> 0)", "mape")
    + ", count(*) FILTER (WHERE actual <> 0) AS mape_records",
)
_one(
    "smape",
    ["smape"],
    r6(
        "100 * avg(abs(actual - predicted) / (abs(actual) + abs(predicted))) "
        "FILTER (WHERE abs(actual) + abs(predicted) <> 0)",
        "smape",
    ),
)
_one("wape", ["wape"], r6("100 * sum(abs(actual - predicted)) / sum(abs(actual))", "wape"))
_one(
    "zero_demand_stats",
    ["total_records", "zero_records", "zero_percentage", "mape_records"],
    "count(*) AS total_records, count(*) FILTER (WHERE actual = 0) AS zero_records, "
    + r6("100.0 * count(*) FILTER (WHERE actual = 0) / count(*)", "zero_percentage")
    + ", count(*) FILTER (WHERE actual <> 0) AS mape_records",
)


@query(
    "prediction_stats",
    with_parts(
        "pred",
        "SELECT "
        + ", ".join(
            r6(f"{function}({column})", f"{name}_{column}")
            for name, function in (
                ("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"),
            )
            for column in ("actual", "predicted")
        )
        + " FROM pred",
    ),
)
def prediction_stats(spark, sf_dir):
    return rounded(metrics.prediction_stats(fixtures.panel_pred(spark, sf_dir)))


# -- error analysis ---------------------------------------------------------


@query(
    "error_columns",
    with_parts(
        "pred",
        f"""SELECT date, {S}, {r6('predicted - actual', 'error')},
        {r6('abs(predicted - actual)', 'abs_error')},
        {r6('(predicted - actual) / nullif(actual, 0) * 100', 'pct_error')} FROM pred""",
    ),
)
def error_columns(spark, sf_dir):
    df = metrics.error_columns(fixtures.panel_pred(spark, sf_dir))
    return rounded(df.select("date", *SERIES, "error", "abs_error", "pct_error"))


DISTRIBUTION = f"""
  {r6('avg(predicted - actual)', 'mean_error')},
  {r6('quantile_cont(predicted - actual, 0.5)', 'median_error')},
  {r6('stddev_samp(predicted - actual)', 'std_error')},
  {r6('min(predicted - actual)', 'min_error')}, {r6('max(predicted - actual)', 'max_error')}
FROM pred"""
PERCENTILES = (
    ", ".join(
        r6(f"quantile_cont(abs(predicted - actual), {share})", name)
        for name, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
    )
    + " FROM pred"
)


@query("error_distribution", with_parts("pred", f"SELECT {DISTRIBUTION}"))
def error_distribution(spark, sf_dir):
    return rounded(metrics.error_distribution(fixtures.panel_pred(spark, sf_dir)))


@query(
    "error_distribution_by_category",
    with_parts("pred", f"SELECT category, {DISTRIBUTION} GROUP BY category"),
)
def error_distribution_by_category(spark, sf_dir):
    return rounded(metrics.error_distribution(fixtures.panel_pred(spark, sf_dir), by=["category"]))


@query("error_percentiles", with_parts("pred", f"SELECT {PERCENTILES}"))
def error_percentiles(spark, sf_dir):
    return rounded(metrics.error_percentiles(fixtures.panel_pred(spark, sf_dir)))


@query(
    "error_percentiles_by_store",
    with_parts("pred", f"SELECT store_id, {PERCENTILES} GROUP BY store_id"),
)
def error_percentiles_by_store(spark, sf_dir):
    return rounded(metrics.error_percentiles(fixtures.panel_pred(spark, sf_dir), by=["store_id"]))


@query(
    "within_tolerance",
    with_parts(
        "pred",
        "SELECT count(*) AS total_records, "
        + ", ".join(
            f"count(*) FILTER (WHERE actual <> 0 AND abs(predicted - actual) / actual <= {t / 100}) "
            f"AS within_{t}pct, "
            + r6(
                f"count(*) FILTER (WHERE actual <> 0 AND abs(predicted - actual) / actual <= {t / 100})"
                " * 100.0 / count(*)",
                f"share_{t}pct",
            )
            for t in (10, 20, 30)
        )
        + " FROM pred",
    ),
)
def within_tolerance(spark, sf_dir):
    return rounded(metrics.within_tolerance(fixtures.panel_pred(spark, sf_dir)))


@query(
    "target_describe",
    with_parts(
        "demand",
        f"""SELECT count(units_sold_7d) AS "count", {r6('avg(units_sold_7d)', 'mean')},
        {r6('stddev_samp(units_sold_7d)', 'std')}, min(units_sold_7d) AS "min",
        {r6('quantile_cont(units_sold_7d, 0.25)', 'p25')},
        {r6('quantile_cont(units_sold_7d, 0.5)', 'p50')},
        {r6('quantile_cont(units_sold_7d, 0.75)', 'p75')}, max(units_sold_7d) AS "max" FROM demand""",
    ),
)
def target_describe(spark, sf_dir):
    return rounded(metrics.target_describe(fixtures.panel_pred(spark, sf_dir)))


@query(
    "store_accuracy",
    with_parts(
        "split",
        f"""SELECT store_id, count(*) AS records, {r6('avg(abs(predicted - actual))', 'mae')},
        {r6('(1 - avg(abs(predicted - actual)) / avg(actual)) * 100', 'accuracy')}
        FROM split WHERE split = 'valid' GROUP BY store_id""",
    ),
)
def store_accuracy(spark, sf_dir):
    valid = fixtures.panel_split(spark, sf_dir).filter("split = 'valid'")
    return rounded(metrics.store_accuracy(valid))


# -- assessments ------------------------------------------------------------

QUALITY = (
    "CASE WHEN wape_accuracy >= 90 THEN 'EXCELLENT' WHEN wape_accuracy >= 80 THEN 'GOOD' "
    "WHEN wape_accuracy >= 70 THEN 'MODERATE' ELSE 'POOR' END AS quality_grade, "
    "CASE WHEN zero_percentage > 20 THEN 'WAPE' WHEN zero_percentage > 5 THEN 'SMAPE' "
    "ELSE 'MAPE' END AS recommended_metric"
)


@query(
    "assessment_by_store",
    with_parts(
        "pred",
        f"""SELECT store_id, wape_accuracy, zero_percentage, {QUALITY}
        FROM ({metrics_sql('pred', 'store_id')})""",
    ),
)
def assessment_by_store(spark, sf_dir):
    report = metrics.assessment(
        metrics.all_metrics(fixtures.panel_pred(spark, sf_dir), by=["store_id"])
    )
    return rounded(
        report.select(
            "store_id", "wape_accuracy", "zero_percentage", "quality_grade", "recommended_metric"
        )
    )


def _side(split: str, name: str) -> str:
    return f"({metrics_sql(f'(SELECT * FROM split WHERE split = {split!r}) s', raw=True)}) {name}"


GAPS = ", ".join(
    r6(f"v.{c} - t.{c}", f"{c}_gap") for c in metrics.COMPARED
)
MEAN_GAP = (
    "(abs(v.mape_accuracy - t.mape_accuracy) + abs(v.smape_accuracy - t.smape_accuracy)"
    " + abs(v.wape_accuracy - t.wape_accuracy)) / 3"
)


@query(
    "generalization_gap",
    with_parts(
        "split",
        f"""SELECT {GAPS}, {r6(MEAN_GAP, 'mean_gap')},
        CASE WHEN {MEAN_GAP} < 2 THEN 'EXCELLENT' WHEN {MEAN_GAP} < 5 THEN 'GOOD'
          WHEN {MEAN_GAP} < 10 THEN 'MODERATE' ELSE 'POOR' END AS generalization
        FROM {_side('train', 't')}, {_side('valid', 'v')}""",
    ),
)
def generalization_gap(spark, sf_dir):
    train, valid = split_metrics(fixtures.panel_split(spark, sf_dir))
    return rounded(metrics.generalization_gap(train, valid))


SPLIT_COLUMNS = (
    "mae", "rmse", "r2", "mape", "smape", "wape", "mape_accuracy", "smape_accuracy",
    "wape_accuracy", "zero_percentage",
)
SAVED = ", ".join(
    [r6(f"t.{c}", f"train_{c}") for c in SPLIT_COLUMNS]
    + [r6(f"v.{c}", f"valid_{c}") for c in (*SPLIT_COLUMNS, "mase")]
    + ["t.zero_records AS train_zero_records", "v.zero_records AS valid_zero_records"]
)
VALID_SIDE = (
    "("
    + metrics_sql("(SELECT * FROM split WHERE split = 'valid') s", train=POOLED_NAIVE, raw=True)
    + ") v"
)


@query(
    "training_record",
    with_parts(
        "split",
        f"""SELECT {SAVED}, t.total_records AS train_records, v.total_records AS valid_records,
        {r6('v.wape_accuracy', 'primary_accuracy')}, 'WAPE' AS primary_metric,
        (SELECT strftime(make_timestamp(CAST(floor(quantile_cont(
           date_diff('day', DATE '1970-01-01', date), 0.8) * 86400) AS BIGINT) * 1000000),
           '%Y-%m-%d %H:%M:%S') FROM panel) AS split_date
        FROM {_side('train', 't')}, {VALID_SIDE}""",
    ),
)
def training_record_of_baseline(spark, sf_dir):
    panel = fixtures.retail_panel(spark, sf_dir)
    return rounded(training_record(fixtures.panel_split(spark, sf_dir), panel))


def _status(change: str) -> str:
    return (
        f"CASE WHEN abs({change}) < 5 THEN 'CONSISTENT' WHEN {change} > 0 THEN 'IMPROVED' "
        "ELSE 'DEGRADED' END"
    )


DRIFT = ", ".join(
    f"{r6(f'c.{m}', m)}, {r6(f'v.{m}', f'valid_{m}')}, {r6(f'c.{m} - v.{m}', f'{m[:-9]}_change')}, "
    f"{_status(f'(c.{m} - v.{m})')} AS {m[:-9]}_status"
    for m in ("wape_accuracy", "mape_accuracy")
)


@query(
    "drift_status",
    with_parts(
        "split",
        f"SELECT {DRIFT} FROM ({metrics_sql('pred', raw=True)}) c, {_side('valid', 'v')}",
    ),
)
def drift_status(spark, sf_dir):
    split = fixtures.panel_split(spark, sf_dir)
    saved = training_record(split, fixtures.retail_panel(spark, sf_dir))
    return rounded(metrics.drift(metrics.all_metrics(split), saved))


@query(
    "evaluation_overall",
    with_parts(
        "pred",
        f"""SELECT *, {GRADE} FROM (
          SELECT *, {QUALITY}, (SELECT {r6('100 - 100 * avg(abs(predicted - actual) / nullif(actual, 0))', 'x')}
            FROM pred) AS accuracy FROM ({metrics_sql('pred')}))""",
    ),
)
def evaluation_overall(spark, sf_dir):
    overall = evaluation_sections(fixtures.panel_pred(spark, sf_dir))["overall"]
    return rounded(overall)


@query(
    "evaluation_detail",
    with_parts(
        "pred",
        f"""SELECT date, {S}, actual, {r6('predicted', 'predicted')}, {r6('predicted - actual', 'error')},
        {r6('abs(predicted - actual)', 'abs_error')},
        {r6('(predicted - actual) / nullif(actual, 0) * 100', 'pct_error')} FROM pred""",
    ),
)
def evaluation_detail(spark, sf_dir):
    from ..sources.panel import EVALUATION_COLUMNS

    detail = metrics.error_columns(fixtures.panel_pred(spark, sf_dir))
    return rounded(detail.select(*EVALUATION_COLUMNS))

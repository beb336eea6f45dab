"""The physical plans keep the shuffles, pushdowns and limits they were built for."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from shelfcast.catalog import QUERIES, fixtures
from shelfcast.operators import history, metrics
from shelfcast.operators.clean import series_filter
from shelfcast.operators.features import create_features, features_with_baseline
from shelfcast.operators.inventory import inventory_policy
from shelfcast.operators.models import BaselineForecaster
from shelfcast.plans import evaluation
from shelfcast.plans.recommend import bulk_recommend, scored_history, series_summary
from shelfcast.plans.reorder import reorder_recommendations
from shelfcast.sources.panel import keep_last, read_panel, save_bucketed, write_panel


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel"))
    write_panel(fixtures.retail_panel(spark, SMALL), path)
    return read_panel(spark, path, fmt="parquet").drop("year")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


def test_features_need_one_exchange_and_one_sort(panel):
    text = plan_of(create_features(panel))
    assert exchanges(text) == ["hashpartitioning"]
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_policy_reuses_the_feature_layout(panel):
    demand = features_with_baseline(panel).withColumnRenamed("predicted", "predicted_weekly_demand")
    assert exchanges(plan_of(inventory_policy(demand))) == ["hashpartitioning"]
    rows = reorder_recommendations(panel, BaselineForecaster())
    assert exchanges(plan_of(rows)) == ["hashpartitioning"]


def test_bulk_recommendations_shuffle_the_panel_once(panel):
    text = plan_of(bulk_recommend(panel, "2001-12-03", BaselineForecaster()))
    assert exchanges(text) == ["hashpartitioning"]


def test_series_summary_with_periods_shuffles_once(panel):
    scored = scored_history(panel, BaselineForecaster())
    text = plan_of(series_summary(scored, {"last_7_days": 7}, periods=True))
    assert exchanges(text) == ["hashpartitioning"]


def test_series_filter_reaches_the_scan(panel):
    text = plan_of(series_filter(panel, "S00001", "PROMO").select("date", "units_sold"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(store_id,S00001)" in pushed and "EqualTo(product_id,PROMO)" in pushed
    read = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "price" not in read and "units_sold" in read


def test_year_folders_are_pruned(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    write_panel(fixtures.retail_panel(spark, SMALL), path)
    text = plan_of(read_panel(spark, path, fmt="parquet").filter("year = 1999"))
    assert "1999" in re.search(r"PartitionFilters: \[(.*?)\]", text).group(1)


@pytest.mark.parametrize("build", ["latest", "recent", "upsert"])
def test_row_limits_apply_before_the_shuffle(panel, build):
    scored = panel.select("*", F.col("price").alias("actual"), F.col("discount").alias("predicted"))
    df = {
        "latest": lambda: history.latest_row(panel),
        "recent": lambda: history.recent_error(scored),
        "upsert": lambda: keep_last(panel, [F.col("price")]),
    }[build]()
    text = plan_of(df)
    partial = text.index("Partial") if "Partial" in text else -1
    assert "WindowGroupLimit" in text and partial > text.index("Exchange")


def test_metrics_are_one_pass(panel):
    scored = panel.select("store_id", F.col("price").alias("actual"), F.col("discount").alias("predicted"))
    text = plan_of(metrics.all_metrics(scored, by=["store_id"]))
    assert text.count("FileScan") == 1 and exchanges(text) == ["hashpartitioning"]


ROW_LEVEL = [
    "create_features",
    "baseline_predict",
    "inventory_policy",
    "reorder_recommendations",
    "bulk_recommend",
    "recommend",
    "history_report",
    "forecast_tail",
    "upsert_keep_last",
    "resample_month",
    "error_columns",
    "inventory_view",
    "sales_view",
]


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_row_level_query_gathers_rows_in_one_task(spark, name):
    text = plan_of(QUERIES[name](spark, SMALL))
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("by", [None, ["store_id"], ["category"]])
def test_mase_stays_in_the_jvm(spark, by):
    split = fixtures.panel_split(spark, SMALL)
    text = plan_of(metrics.naive_error(split.filter("split = 'train'"), by=by))
    assert "InPandas" not in text and "Python" not in text
    # The steps inside the series lie where the features left them.
    inside = plan_of(metrics.naive_error(split.filter("split = 'train'"), by=by, scope="series"))
    panel_moves = [line for line in inside.splitlines() if "Exchange hashpartitioning(store_id" in line and "product_id" in line]
    assert len(panel_moves) <= 1


def test_report_sections_scan_and_shuffle_once(spark, panel, monkeypatch):
    seen = []
    monkeypatch.setattr(metrics, "durable", lambda df: seen.append(plan_of(df)) or df)
    scored = scored_history(panel, BaselineForecaster())
    report = evaluation.report_metrics(scored)
    assert report.select("section").distinct().count() == 4
    (text,) = seen
    # The features' exchange by series and one for all four sections.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert len(re.findall(r"Scan parquet", text)) == 1


def test_a_bucketed_panel_is_not_moved(spark, tmp_path):
    save_bucketed(fixtures.retail_panel(spark, SMALL), "bucketed_panel", 4, str(tmp_path / "panel"))
    stored = spark.table("bucketed_panel")
    demand = features_with_baseline(stored).withColumnRenamed("predicted", "predicted_weekly_demand")
    for df in (create_features(stored), inventory_policy(demand), history.latest_row(stored)):
        assert exchanges(plan_of(df)) == []
    spark.sql("DROP TABLE bucketed_panel")

"""Hand-worked cases of the rules, the rounding and the metrics."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.functions import numeric, rules
from shelfcast.operators import features, metrics
from shelfcast.operators.inventory import inventory_policy
from shelfcast.plans.recommend import bulk_rows, single_documents


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(p)) for a, p in rows], "actual double, predicted double")


def one(df):
    return df.collect()[0]


def test_rounding_equals_python(spark):
    draw = random.Random(7)
    values = [2.675, 1.005, 0.125, -0.125, -2.675, 2.5, -2.5, 0.015, 1e6 + 0.005, 0.0]
    values += [draw.randint(-(10**6), 10**6) / 1000 for _ in range(4000)]
    values += [draw.uniform(-1000, 1000) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2):
        got = df.select("x", numeric.py_round("x", digits).alias("r")).collect()
        assert [r.r for r in got] == [round(r.x, digits) for r in got]


def test_whole_numbers_round_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(numeric.whole(F.col("x"))).collect()] == [0, 2, 2]


@pytest.mark.parametrize(
    "value,text",
    [(79.2, "79.2"), (100.0, "100.0"), (0.25, "0.25"), (12345678.5, "12345678.5"), (0.0, "0.0")],
)
def test_float_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert one(df.select(numeric.float_text(F.col("x"))))[0] == text


def test_iso_weeks(spark):
    days = ["2020-12-31", "2021-01-03", "2023-01-01", "2024-12-30"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("date"))
    assert [r.week for r in features.calendar_features(df).collect()] == [53, 53, 52, 1]


def test_zero_actuals(spark):
    row = one(metrics.all_metrics(pairs(spark, [(0, 1), (0, 2), (0, 3)])))
    assert (row.mape, row.wape, row.smape) == (0.0, 0.0, 100.0)
    assert (row.zero_records, row.mape_records, row.zero_percentage) == (3, 0, 100.0)
    assert (row.mape_accuracy, row.smape_accuracy) == (100.0, 0.0)


def test_all_zero(spark):
    row = one(metrics.all_metrics(pairs(spark, [(0, 0), (0, 0)])))
    assert (row.smape, row.r2, row.mae) == (0.0, 1.0, 0.0)


def test_constant_actual_and_single_row(spark):
    assert one(metrics.all_metrics(pairs(spark, [(5, 4), (5, 6)]))).r2 == 0.0
    assert one(metrics.all_metrics(pairs(spark, [(5, 4)]))).r2 is None


def test_mape_with_zeros_kept_has_no_result(spark):
    df = pairs(spark, [(0, 1), (2, 1)])
    assert one(metrics.all_metrics(df, exclude_zeros=False)).mape == 0.0
    assert one(metrics.all_metrics(df)).mape == 50.0


def train_rows(spark, values):
    rows = [("S", "P", f"2024-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "store_id string, product_id string, date string, actual double")
    return df.withColumn("date", F.to_date("date"))


@pytest.mark.parametrize("train,mase", [([5, 5, 5], 0.0), ([5], 2.0), ([1, 3, 5], 1.0)])
def test_mase(spark, train, mase):
    df = pairs(spark, [(4, 2), (4, 6)])
    assert one(metrics.all_metrics(df, train=train_rows(spark, train))).mase == mase


def test_empty_input_gives_no_accuracy(spark):
    row = one(metrics.all_metrics(pairs(spark, [(1, 1)]).filter("actual > 5")))
    assert row.total_records == 0 and row.mae is None


def test_single_row_series_has_no_safety_stock(spark):
    df = spark.createDataFrame(
        [("S", "P", 10.0, 4)],
        "store_id string, product_id string, predicted_weekly_demand double, inventory_level int",
    )
    row = one(inventory_policy(df))
    assert (row.demand_std, row.safety_stock, row.reorder_point) == (0.0, 0.0, 10.0)
    assert (row.order_quantity, row.stockout_risk) == (6.0, 1)


BANDS = [
    (79, "CRITICAL", 1, 65, "ORDER_IMMEDIATELY"),
    (80, "LOW", 2, 35, "ORDER_SOON"),
    (99, "LOW", 2, 16, "ORDER_SOON"),
    (100, "ADEQUATE", 3, 20, "MONITOR"),
    (119, "ADEQUATE", 3, 1, "MONITOR"),
    (120, "EXCESS", 4, 0, "NO_ORDER_NEEDED"),
]


def latest_rows(spark, stocks, error=20.0):
    rows = [("S", f"P{i}", s, 100.0, error, 2.0, "C") for i, s in enumerate(stocks)]
    df = spark.createDataFrame(
        rows,
        "store_id string, product_id string, inventory_level int, predicted double, "
        "mean_error double, price double, first_category string",
    )
    return df.withColumn("date", F.lit("2024-01-15").cast("date"))


def test_bulk_bands(spark):
    df = latest_rows(spark, [band[0] for band in BANDS]).withColumn("last_4_weeks", F.array())
    got = {r.current_stock: r for r in bulk_rows(df).collect()}
    for stock, status, priority, order, _ in BANDS:
        row = got[stock]
        assert (row.status, row.priority, row.recommended_order) == (status, priority, order)
        assert (row.low_estimate, row.high_estimate, row.confidence) == (80.0, 120.0, "80.0%")
    assert got[79].demand_breakdown.monthly.average == 433.0
    assert got[79].lost_revenue_risk == 42.0


def test_single_bands_and_texts(spark):
    df = latest_rows(spark, [band[0] for band in BANDS])
    for name in ("last_7_days", "last_6_weeks", "last_3_months"):
        df = df.withColumn(name, F.array())
    got = {r.summary.current_stock: r for r in single_documents(df).collect()}
    for stock, status, _, order, action in BANDS:
        row = got[stock]
        assert row.summary.stock_status == ("CRITICAL_LOW" if status == "CRITICAL" else status)
        assert row.summary.action_needed == action
        assert row.stock_recommendation.recommended_order_quantity == order
    assert got[79].summary.simple_explanation == (
        "You currently have 79 units in stock. Based on past sales, you will likely sell 100.0 "
        "units this week. This means you are SHORT by 21.0 units. Order at least 65 units to "
        "avoid losing ₹42.0 in sales."
    )
    assert got[100].summary.simple_explanation.endswith(
        "Your stock level is PERFECT for this week's demand."
    )


def test_no_usable_error_leaves_the_band_empty(spark):
    df = latest_rows(spark, [79, 120], error=None).withColumn("last_4_weeks", F.array())
    got = {r.current_stock: r for r in bulk_rows(df).collect()}
    assert got[79].low_estimate is None and got[79].status == "LOW"
    assert got[120].status == "EXCESS" and got[120].recommended_order == 0


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(0, 300), st.floats(0, 200, width=32), st.floats(0, 100, width=32)
        ),
        min_size=1,
        max_size=30,
    )
)
def test_band_properties(spark, cases):
    rows = [("S", f"P{i}", s, float(p), float(e), 1.0, "C") for i, (s, p, e) in enumerate(cases)]
    df = spark.createDataFrame(
        rows,
        "store_id string, product_id string, inventory_level int, predicted double, "
        "mean_error double, price double, first_category string",
    )
    df = df.withColumn("date", F.lit("2024-01-15").cast("date")).withColumn("last_4_weeks", F.array())
    for row in bulk_rows(df).collect():
        assert row.low_estimate <= row.predicted_demand <= row.high_estimate
        assert row.recommended_order >= 0 and row.shortage >= 0


@pytest.mark.parametrize(
    "accuracy,grade", [(90, "EXCELLENT"), (89.9, "GOOD"), (80, "GOOD"), (70, "MODERATE"), (69, "POOR")]
)
def test_quality_grades(spark, accuracy, grade):
    df = spark.createDataFrame([(float(accuracy),)], "a double")
    assert one(df.select(rules.quality_grade(F.col("a"))))[0] == grade


@pytest.mark.parametrize("zero,metric", [(21, "WAPE"), (20, "SMAPE"), (6, "SMAPE"), (5, "MAPE")])
def test_recommended_metric(spark, zero, metric):
    df = spark.createDataFrame([(float(zero),)], "z double")
    assert one(df.select(rules.recommended_metric(F.col("z"))))[0] == metric


@pytest.mark.parametrize(
    "change,status", [(4.9, "CONSISTENT"), (-4.9, "CONSISTENT"), (5, "IMPROVED"), (-5, "DEGRADED")]
)
def test_drift_status(spark, change, status):
    df = spark.createDataFrame([(float(change),)], "c double")
    assert one(df.select(rules.drift_status(F.col("c"))))[0] == status

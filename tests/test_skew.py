"""A key with a third of all rows is split, not sent to one task."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures
from shelfcast.operators import clean, integrity, models
from shelfcast.operators.encode import encode, fit_encoders
from shelfcast.operators.joins import split_join
from shelfcast.operators.views import sales_view
from shelfcast.plans.recommend import recommend

# Small enough for a few thousand rows to count as skewed; no broadcast joins.
SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
}


@pytest.fixture
def splitting(spark):
    before = {key: spark.conf.get(key, None) for key in SPLITTING}
    for key, value in SPLITTING.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_rows(spark, rows=60_000, files=6):
    """Two thirds of the rows spread over many stores, one third in S0."""
    store = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(0, rows, 1, files).select(
        F.concat(F.lit("S"), store).alias("store_id"), F.sha2(F.col("id").cast("string"), 256).alias("x")
    )


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_key_is_split_beside_an_aggregate(splitting, how):
    left = hot_rows(splitting)
    right = left.groupBy("store_id").count()
    rows, plan = final_plan(split_join(left, right, ["store_id"], how))
    assert "skew=true" in plan
    assert len(rows) == 60_000


def test_gate_and_filter_split_a_hot_store(splitting):
    left = hot_rows(splitting)
    rows, plan = final_plan(clean.min_rows_gate(left, 200))
    assert "skew=true" in plan and {r.store_id for r in rows} == {"S0"}
    rows, plan = final_plan(clean.store_filter(left, left.select("store_id")))
    assert "skew=true" in plan and len(rows) == 60_000


def test_encoding_splits_a_hot_label(splitting):
    left = hot_rows(splitting)
    rows, plan = final_plan(encode(left, fit_encoders(left, ["store_id"]), ["store_id"]))
    assert "skew=true" in plan and len(rows) == 60_000


def test_views_split_a_hot_key(splitting):
    store = splitting.range(500).select(F.concat(F.lit("S"), "id").alias("id"), F.lit("n").alias("name"))
    product = splitting.range(5).select(F.col("id").cast("string"), F.lit("p").alias("name"))
    sales = hot_rows(splitting).withColumn("product_id", F.lit("1"))
    rows, plan = final_plan(sales_view(sales, store, product))
    assert "skew=true" in plan and len(rows) == 60_000


def test_scenarios_on_one_series(splitting):
    base = fixtures.scenarios(splitting, SMALL)
    hot = base.filter("store_id = 'S00001' and product_id = 'PROMO'")
    copies = splitting.range(0, 3000, 1, 6).select(F.col("id").alias("n"))
    many = hot.crossJoin(copies).withColumn("price", F.col("n").cast("double") + 1).drop("n")
    panel = fixtures.retail_panel(splitting, SMALL)
    rows, plan = final_plan(recommend(base.unionByName(many), panel, models.BaselineForecaster()))
    assert len(rows) == 3060 and "skew=true" in plan


def test_foreign_keys_are_counted_before_the_join(spark):
    sales = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 99).otherwise(F.col("id") % 7).cast("int").alias("store_id"),
        F.lit(1).alias("product_id"),
    )
    parents = {"store": spark.range(7).toDF("id"), "product": spark.range(2).toDF("id")}
    found = integrity.check_foreign_keys("sales", sales, parents).collect()
    assert [(r.key, r.value, r.rows) for r in found] == [("store_id", 99, 6667)]

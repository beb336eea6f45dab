"""Rows of the panel, and of what is computed along its series, that fall to one task."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures, panel_queries
from shelfcast.operators.features import features_with_baseline

LINES = 3_000
TASK_ROWS = 100


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    day = datetime(2000, 1, 1)
    lines = [(k % 40 if k % 50 else None, k % 25, 1 + k % 4, float(1 + k % 60), 0.01 * (k % 10), day + timedelta(days=k % 70)) for k in range(LINES)]
    kinds = ("ECONOMY", "PROMO", "SMALL", None)
    given = {
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp"),
        "part": ([(k, kinds[k % 4], k % 9, 10.0 + k) for k in range(40)], "p_partkey long, p_type string, p_size int, p_retailprice double"),
        # A key that comes twice.
        "supplier": ([(k, f"s{k}", k % 3) for k in (*range(25), 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(k, k % 2) for k in range(3)], "n_nationkey int, n_regionkey int"),
        "region": ([(k, f"R{k}") for k in range(2)], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", TASK_ROWS)
    fixtures.panel_tasks.cache_clear()
    yield
    fixtures.panel_tasks.cache_clear()


def test_tasks_grow_with_the_sales(spark, tables, small_tasks):
    panel = fixtures.retail_panel(spark, tables)
    assert panel.rdd.getNumPartitions() == LINES // TASK_ROWS
    # Adaptive execution does not merge them, and windows along series keep them.
    assert features_with_baseline(panel).rdd.getNumPartitions() == LINES // TASK_ROWS
    assert features_with_baseline(panel).count() == panel.count()


def test_rows_of_the_panel_do_not_depend_on_the_layout(spark, tables, small_tasks):
    fine = sorted(map(str, fixtures.retail_panel(spark, tables).collect()))
    plain = (
        spark.read.parquet(f"{tables}/lineitem.parquet")
        .join(spark.read.parquet(f"{tables}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
        .join(fixtures.supplier_regions(spark, tables), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), "l_suppkey", "p_type", "r_name")
        .agg(F.greatest(F.sum("l_quantity") - 20, F.lit(0)).cast("int").alias("units"))
    )
    expected = sorted((str(r.date), f"S{r.l_suppkey:05d}", str(r.p_type), r.r_name, r.units) for r in plain.collect())
    found = fixtures.retail_panel(spark, tables).collect()
    assert sorted((str(r.date), r.store_id, str(r.product_id), r.region, r.units_sold) for r in found) == expected
    assert sorted(map(str, found)) == fine


def test_buckets_grow_with_the_sales(spark, tables, small_tasks, monkeypatch):
    seen, save = [], panel_queries.source.save_bucketed
    monkeypatch.setattr(panel_queries.source, "save_bucketed", lambda df, name, buckets, path: (seen.append(buckets), save(df, name, buckets, path)))
    assert panel_queries.bucketed_features(spark, tables).count() == fixtures.retail_panel(spark, tables).count()
    assert seen == [LINES // TASK_ROWS]


def test_sales_are_moved_once(spark, tables, small_tasks):
    """Stores are looked up without sorting the sales by supplier first."""
    plan = fixtures.retail_panel(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookups_that_miss_or_match_twice(spark, tables, tmp_path):
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    given = {
        "supplier": ([(1, "a", 0), (2, "b", None), (3, "c", 1), (3, "d", 1), (4, "e", 9), (None, "f", 0)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, 0), (0, 1), (1, 0), (None, 0), (2, None)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "R0"), (1, None), (None, "R2")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    path = str(tmp_path)
    stores = fixtures.supplier_regions(spark, path)
    lines = spark.read.parquet(f"{path}/lineitem.parquet").join(spark.read.parquet(f"{path}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    plain = lines.join(stores, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_shipdate").cast("date").alias("date"), "l_suppkey", "p_type", "r_name")
    expected = sorted((str(r.date), f"S{r.l_suppkey:05d}", str(r.p_type), str(r.r_name), int(max(r.units - 20, 0))) for r in plain.agg(F.sum("l_quantity").alias("units")).collect())
    found = fixtures.retail_panel(spark, path).collect()
    assert expected and sorted((str(r.date), r.store_id, str(r.product_id), str(r.region), r.units_sold) for r in found) == expected

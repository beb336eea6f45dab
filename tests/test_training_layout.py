"""Training rows: their share per task, and how often they are computed."""

from datetime import date, timedelta

import pytest

from shelfcast.operators import models
from shelfcast.operators.encode import encode, fit_encoders
from shelfcast.plans import training as plans
from shelfcast.plans.training import train_stores

COLUMNS = (
    "date date, store_id string, product_id string, category string, region string, inventory_level int, units_sold int, price double, "
    "discount double, weather_condition string, holiday_promotion int, competitor_pricing double, seasonality string"
)


@pytest.fixture(scope="module")
def panel(spark):
    day = date(2000, 1, 1)
    rows = [
        (day + timedelta(days=k), f"S{s}", f"P{p}", "Core" if p else "Promo", f"R{s}", 10 + k % 7, (k * (p + 2)) % 30, 5.0 + p, k % 4 * 1.0, "Sunny", k % 2, 6.0 + k % 3, ("Winter", "Summer")[k // 60 % 2])
        for s in range(3) for p in range(2) for k in range(120)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_training_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    rows = spark.range(0, 1_000, 1, 2).toDF("id")
    spread = models.spread_rows(rows, 1_000)
    assert spread.rdd.getNumPartitions() == 10 and max(spread.rdd.glom().map(len).collect()) <= 110
    assert sorted(r.id for r in spread.collect()) == list(range(1_000))
    assert models.spread_rows(rows.repartition(12), 1_000).rdd.getNumPartitions() == 12


def test_small_encoders_do_not_move_the_rows(panel):
    placed = panel.repartition(7)
    coded = encode(placed, fit_encoders(panel))
    assert "SortMergeJoin" not in plan(coded)
    assert coded.rdd.getNumPartitions() == 7 and coded.filter("product_id_idx is null").isEmpty()


def test_released_training_is_not_computed_again(panel):
    training = train_stores(panel)
    training.release()
    assert "Window" not in plan(training.summary) and "Window" not in plan(training.coefficients)
    assert sorted((r.store_id, r.records) for r in training.summary.collect()) == [(f"S{s}", 240) for s in range(3)]


def test_cells_are_summed_without_a_sort(panel):
    from shelfcast.operators.clean import clean_panel
    from shelfcast.operators.features import create_features

    clean = clean_panel(panel)
    featured = encode(create_features(clean), fit_encoders(clean), ("product_id",))
    cells = models.store_cells(models.training_rows(featured, clean, with_low=True))
    assert "SortAggregate" not in plan(cells)
    assert cells.groupBy("store_id").sum("n").count() == 3 and cells.filter("low[0] is null").isEmpty()


def test_training_rows_are_not_moved_by_store(spark, panel, monkeypatch):
    """Features lie by series, and a store's split date comes to its series; before, all rows went by store to the join and to the scores."""
    plans_of, store = {}, plans.stored
    monkeypatch.setattr(plans, "stored", lambda df, name: (plans_of.setdefault(name, plan(df)), store(df, name))[1])
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summary = train_stores(panel).summary
        scored = plan(summary)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    rows = plans_of["training"].split("\n")
    window = next(k for k, line in enumerate(rows) if "Window" in line)
    depth = [line.find(next(c for c in line if c.isalnum() or c == "*")) for line in rows[: window + 1]]
    above = [rows[k] for k in range(window) if all(depth[j] > depth[k] for j in range(k + 1, window + 1))]
    assert not any("Exchange" in line and "product_id" not in line for line in above)
    assert "valid" in next(line for line in scored.split("\n") if "PushedFilters" in line and "split" in line)
    assert sorted((r.store_id, r.records, r.mae is not None) for r in summary.collect()) == [(f"S{s}", 240, True) for s in range(3)]

"""Batches into a stored panel, and features of new rows from the state before them."""

import datetime
import re
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures
from shelfcast.operators import features
from shelfcast.schema import SERIES
from shelfcast.sources import panel as source


@pytest.fixture(scope="module")
def panel(spark):
    return fixtures.retail_panel(spark, SMALL).cache()


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_batch_touches_its_years_only(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    old = panel.filter("date < '2000-07-01'")
    new = panel.filter("date >= '2000-06-01' and date < '2000-08-01'").withColumn("units_sold", F.col("units_sold") + 1)
    source.write_panel(old, path)
    before = files_of(path)
    assert source.merge_batch(new, path) == [2000]
    after = files_of(path)
    assert {f for f in before if "year=2000" not in f} <= set(after)
    assert all(after[f] == t for f, t in before.items() if "year=2000" not in f)
    assert not any("year=2000" in f for f in set(before) & set(after))
    expected = source.upsert_keep_last(old, new)
    assert rows_of(spark.read.parquet(path), old.columns) == rows_of(expected, old.columns)
    # Again: nothing changes.
    source.merge_batch(new, path)
    assert rows_of(spark.read.parquet(path), old.columns) == rows_of(expected, old.columns)


def test_other_years_are_pruned_from_the_scan(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    source.write_panel(panel, path)
    new = panel.filter("date >= '1999-12-01' and date < '2000-02-01'")
    years = source.touched_years(new)
    assert sorted(years) == [1999, 2000]
    old = source.read_years(spark, path, years)
    text = old._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year", text)
    assert old.select("year").distinct().count() == 2


def test_a_batch_makes_a_panel_and_may_be_empty_or_undated(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    assert source.merge_batch(panel.limit(0), path) == []
    first = panel.filter("date < '1995-06-01'")
    source.merge_batch(first, path)
    undated = panel.limit(1).withColumn("date", F.lit(None).cast("date"))
    assert source.merge_batch(undated, path) == [None]
    assert spark.read.parquet(path).count() == first.count() + 1


FEATURES = ["date", *SERIES, "units_sold", "units_sold_7d", "lag_7", "lag_60", "rolling_mean_7", "rolling_mean_30", "week"]


def updated(before, batch, full):
    found, state = features.update_features(features.feature_state(before), batch, before)
    first = batch.groupBy(*SERIES).agg(F.min("date").alias("first"))
    expected = features.create_features(full).join(first, list(SERIES)).filter("date >= first")
    assert rows_of(found, FEATURES) == rows_of(expected, FEATURES)
    assert rows_of(state, full.columns) == rows_of(features.feature_state(full), full.columns)


def test_new_rows_need_the_state_only(panel):
    before, batch = panel.filter("date < '2001-01-01'"), panel.filter("date >= '2001-01-01'")
    updated(before, batch, panel)
    unread = before.withColumn("units_sold", F.raise_error(F.lit("read")).cast("int"))
    found, _ = features.update_features(features.feature_state(before), batch, unread)
    assert found.count() == batch.count()


def test_late_rows_take_their_series_from_the_panel(panel):
    before = panel.filter("date < '2001-01-01' and not (product_id = 'PROMO' and month(date) = 3)")
    corrected = before.filter("product_id = 'STANDARD' and date = '1999-05-05'").withColumn("units_sold", F.col("units_sold") + 9)
    batch = panel.filter("date >= '2001-01-01' or (product_id = 'PROMO' and month(date) = 3)").unionByName(corrected)
    full = source.upsert_keep_last(before, batch)
    updated(before, batch, full)


def test_a_series_without_history_and_an_empty_batch(panel):
    before = panel.filter("store_id <> 'S00001'")
    batch = panel.filter("store_id = 'S00001'")
    updated(before, batch, panel)
    found, state = features.update_features(features.feature_state(before), panel.limit(0), before)
    assert found.isEmpty() and state.count() == features.feature_state(before).count()


def test_state_holds_the_rows_that_windows_look_back_on(panel):
    state = features.feature_state(panel)
    assert state.groupBy(*SERIES).count().agg(F.max("count")).first()[0] == features.LOOKBACK
    assert state.agg(F.max("date")).first()[0] == panel.agg(F.max("date")).first()[0]
    assert isinstance(state.first().date, datetime.date)

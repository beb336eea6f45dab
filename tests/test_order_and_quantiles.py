"""Global ranks, segments, gaps and percentiles against plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.operators.features import LOOKBACK, create_features, features_with_baseline
from shelfcast.operators.ordering import adjacent_gaps, segments, with_global_rank
from shelfcast.operators.quantiles import exact_percentiles
from shelfcast.sources.panel import keep_last

SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def check_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, "v", SHARES, ["g"]).collect()}
    groups = {g for g, v in rows if v is not None}
    assert set(got) == groups
    for group in groups:
        values = [v for g, v in rows if g == group and v is not None]
        for name, share in SHARES.items():
            assert got[group][name] == pytest.approx(np.quantile(values, share), rel=1e-12, abs=1e-12)


def test_percentiles_of_skewed_groups(spark):
    draw = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in draw.normal(0, 5, 6000)]
    rows += [("ties", 1.5)] * 3000 + [("ties", float(v)) for v in draw.integers(-3, 4, 500)]
    rows += [("single", 4.0), ("pair", 1.0), ("pair", 2.0), ("pair", None), (None, 7.0)]
    check_percentiles(spark, rows)


@settings(max_examples=4, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ab"),
            st.floats(-1e6, 1e6, allow_nan=False).filter(lambda v: v == 0 or abs(v) > 1e-6),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_percentiles_of_any_values(spark, rows):
    check_percentiles(spark, rows)


def test_percentiles_ignore_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,)], "v double")
    assert exact_percentiles(df, "v", {"p50": 0.5}).collect()[0].p50 == 2.0


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = with_global_rank(df, ["k"], "r").collect()
    assert all(row.k == row.r for row in rows)


def hot_panel(spark, hot=900, cold=40):
    """One series holds most rows; each has gaps."""
    rows = spark.range(hot).select(F.lit("S1").alias("store_id"), F.lit("P1").alias("product_id"), "id")
    others = spark.range(cold * 5).select(
        F.lit("S2").alias("store_id"), F.concat(F.lit("P"), F.col("id") % 5).alias("product_id"), "id"
    )
    return rows.unionByName(others).select(
        "store_id",
        "product_id",
        F.expr("date_add(date'2020-01-01', cast(id * 2 + id % 2 as int))").alias("date"),
        (F.col("id") * 37 % 11).cast("int").alias("units_sold"),
    )


def as_set(df):
    names = sorted(df.columns)
    return sorted(tuple(row[name] for name in names) for row in df.collect())


def test_segments_bound_every_group(spark):
    cut = segments(hot_panel(spark), ["store_id", "product_id"], ["date"], LOOKBACK, 100)
    sizes = cut.groupBy("store_id", "product_id", "_segment").count().agg(F.max("count")).collect()
    assert sizes[0][0] <= 100 + LOOKBACK
    assert cut.filter("not _halo").count() == hot_panel(spark).count()


@pytest.mark.parametrize("rows", [68, 100, 5000])
def test_segmented_features_equal_plain_features(spark, rows):
    panel = hot_panel(spark)
    assert as_set(features_with_baseline(panel, segment_rows=rows)) == as_set(
        features_with_baseline(panel)
    )


def test_segments_need_room_for_the_lookback(spark):
    with pytest.raises(ValueError):
        create_features(hot_panel(spark), segment_rows=10)


def test_features_do_not_depend_on_row_order_or_partitions(spark):
    panel = hot_panel(spark, 200, 20)
    shuffled = panel.repartition(13).orderBy(F.rand(5))
    assert as_set(create_features(panel)) == as_set(create_features(shuffled))


def test_features_with_equal_dates_follow_the_tie_break(spark):
    rows = [("S", "P", "2024-01-01", i, i + 1) for i in range(100)]
    df = spark.createDataFrame(
        rows, "store_id string, product_id string, date string, seq int, units_sold int"
    ).withColumn("date", F.to_date("date"))
    whole = create_features(df, tie_break=["seq"])
    cut = create_features(df, segment_rows=70, tie_break=["seq"])
    assert as_set(whole) == as_set(cut)
    assert whole.filter("seq = 2").collect()[0].units_sold_7d == 6.0


@pytest.mark.parametrize("by", [[], ["s"]])
def test_adjacent_gaps(spark, by):
    draw = np.random.default_rng(5)
    rows = [("hot" if i % 3 else f"s{i % 7}", i, float(a), float(b))
            for i, (a, b) in enumerate(draw.integers(0, 9, (2000, 2)))]
    df = spark.createDataFrame(rows, "s string, i int, f double, l double").repartition(7)
    got = {tuple(r[k] for k in by): (r.gap_sum, r.gap_count)
           for r in adjacent_gaps(df, ["s", "i"], "f", "l", by).collect()}
    rows.sort(key=lambda r: (r[0], r[1]))
    groups = {tuple([r[0]] if by else []) for r in rows}
    for group in groups:
        own = [r for r in rows if not by or r[0] == group[0]]
        gaps = [abs(b[2] - a[3]) for a, b in zip(own, own[1:])]
        assert got[group] == (sum(gaps), len(gaps))


def test_keep_last_of_a_key_with_most_of_the_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    kept = keep_last(df, [F.col("v")], ["k"])
    assert kept.filter("k = 0").collect()[0].v == 2999
    assert kept.count() == df.select("k").distinct().count()

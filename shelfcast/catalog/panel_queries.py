"""Ingest, cleaning, feature and encoder queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean, encode, features
from ..operators.models import feature_projection, split_date, split_sizes
from ..schema import CATEGORICALS, LAG_COLUMNS, SERIES
from ..session import ensure_checkpoint_dir
from ..sources import panel as source
from . import fixtures
from .oracle import S, W, r6, with_parts
from .registry import query, rounded

PANEL_COLUMNS = (
    "date, store_id, product_id, category, region, inventory_level, units_sold, price, discount, "
    "weather_condition, holiday_promotion, competitor_pricing, seasonality"
)
PANEL_ROUNDED = PANEL_COLUMNS.replace(
    "discount,", "round(discount, 6) AS discount,"
).replace("competitor_pricing,", "round(competitor_pricing, 6) AS competitor_pricing,")


@query("normalize_columns", with_parts("panel", f"SELECT {PANEL_ROUNDED} FROM panel"))
def normalize_columns(spark, sf_dir):
    raw = fixtures.panel_raw(spark, sf_dir)
    return rounded(source.validate_columns(source.normalize_columns(raw)))


DIRTY = """
SELECT CASE WHEN day(date) = 16 THEN NULL ELSE date END AS date, store_id, product_id, category,
  region, inventory_level, CASE WHEN day(date) = 13 THEN -1 ELSE units_sold END AS units_sold,
  CASE WHEN day(date) = 14 THEN 0 ELSE price END AS price, round(discount, 6) AS discount,
  CASE WHEN day(date) <> 15 THEN weather_condition END AS weather_condition,
  holiday_promotion, round(competitor_pricing, 6) AS competitor_pricing, seasonality
FROM panel"""


@query("parse_dates", with_parts("panel", DIRTY))
def parse_dates(spark, sf_dir):
    return rounded(source.parse_dates(fixtures.panel_dirty(spark, sf_dir)))


@query(
    "clean_panel",
    with_parts("panel", f"SELECT {PANEL_ROUNDED} FROM panel WHERE day(date) NOT IN (13, 14, 15, 16)"),
)
def clean_panel(spark, sf_dir):
    return rounded(clean.clean_panel(source.parse_dates(fixtures.panel_dirty(spark, sf_dir))))


@query(
    "series_filter",
    with_parts(
        "panel",
        f"SELECT {PANEL_ROUNDED} FROM panel WHERE store_id = 'S00003' AND product_id = 'PROMO'",
    ),
)
def series_filter(spark, sf_dir):
    return rounded(clean.series_filter(fixtures.retail_panel(spark, sf_dir), "S00003", "PROMO"))


@query(
    "store_filter",
    with_parts(
        "panel store",
        f"""SELECT {PANEL_ROUNDED} FROM panel WHERE store_id IN (
        SELECT concat('S', lpad(CAST(id AS VARCHAR), 5, '0')) FROM store WHERE region = 'EUROPE')""",
    ),
)
def store_filter(spark, sf_dir):
    wanted = fixtures.store(spark, sf_dir).filter(F.col("region") == "EUROPE")
    names = wanted.select(
        F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("store_id")
    )
    return rounded(clean.store_filter(fixtures.retail_panel(spark, sf_dir), names))


@query(
    "min_rows_gate",
    with_parts(
        "panel",
        f"""SELECT {PANEL_ROUNDED} FROM panel WHERE store_id IN (
        SELECT store_id FROM panel GROUP BY store_id HAVING count(*) >= 590)""",
    ),
)
def min_rows_gate(spark, sf_dir):
    return rounded(clean.min_rows_gate(fixtures.retail_panel(spark, sf_dir), 590))


@query(
    "drop_unscored",
    with_parts(
        "pred",
        f"""SELECT date, {S}, actual, {r6('predicted', 'predicted')} FROM pred
        WHERE lag_7 <> 0""",
    ),
)
def drop_unscored(spark, sf_dir):
    df = fixtures.panel_pred(spark, sf_dir)
    # Half of the blanks are nulls, half NaN.
    blank = F.when(F.dayofmonth("date") % 2 == 0, F.lit(float("nan")))
    holes = df.withColumn("predicted", F.when(F.col("lag_7") == 0, blank).otherwise(F.col("predicted")))
    return rounded(clean.drop_unscored(holes).select("date", *SERIES, "actual", "predicted"))


# -- batches ----------------------------------------------------------------

UNION = f"""
SELECT {PANEL_ROUNDED} FROM panel WHERE month(date) <> 7
UNION ALL
SELECT {PANEL_ROUNDED.replace('units_sold', 'units_sold + 1 AS units_sold').replace('weather_condition', 'NULL AS weather_condition')}
FROM panel WHERE month(date) IN (6, 7)"""


@query("union_batches", with_parts("panel", UNION))
def union_batches(spark, sf_dir):
    old, new = fixtures.batch_old(spark, sf_dir), fixtures.batch_new(spark, sf_dir)
    return rounded(source.union_batches(old, new))


UPSERT = UNION.replace("month(date) <> 7", "month(date) NOT IN (6, 7)")


@query("upsert_keep_last", with_parts("panel", UPSERT))
def upsert_keep_last(spark, sf_dir):
    old, new = fixtures.batch_old(spark, sf_dir), fixtures.batch_new(spark, sf_dir)
    return rounded(source.upsert_keep_last(old, new)).select(*old.columns)


@query("upsert_unique", with_parts("panel", UPSERT))
def upsert_unique(spark, sf_dir):
    old, new = fixtures.batch_old(spark, sf_dir), fixtures.batch_new(spark, sf_dir)
    return rounded(source.upsert_unique(old, new)).select(*old.columns)


@query("merge_batch", with_parts("panel", UPSERT))
def merge_batch(spark, sf_dir):
    """The stored panel after a batch that touches only the years it has rows in."""
    old, new = fixtures.batch_old(spark, sf_dir), fixtures.batch_new(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/merged-panel-{uuid.uuid4().hex}"
    source.write_panel(old, path)
    source.merge_batch(new, path)
    return rounded(spark.read.parquet(path).select(*old.columns))


@query(
    "ingest_report",
    with_parts(
        "panel",
        """SELECT count(*) AS records, count(DISTINCT store_id) AS stores, min(date) AS start,
        max(date) AS "end" FROM panel WHERE month(date) IN (6, 7)""",
    ),
)
def ingest_report(spark, sf_dir):
    return source.ingest_report(fixtures.batch_new(spark, sf_dir))


@query("list_stores", with_parts("panel", "SELECT DISTINCT store_id FROM panel"))
def list_stores(spark, sf_dir):
    return source.list_stores(fixtures.retail_panel(spark, sf_dir))


@query("list_products", with_parts("panel", f"SELECT DISTINCT {S} FROM panel"))
def list_products(spark, sf_dir):
    return source.list_products(fixtures.retail_panel(spark, sf_dir))


# -- features ---------------------------------------------------------------

KEY = f"date, {S}"


@query("rolling_demand", with_parts("demand", f"SELECT {KEY}, units_sold, units_sold_7d FROM demand"))
def rolling_demand(spark, sf_dir):
    df = features.rolling_demand(fixtures.retail_panel(spark, sf_dir))
    return df.select("date", *SERIES, "units_sold", "units_sold_7d")


@query("lag_features", with_parts("feats", f"SELECT {KEY}, lag_7, lag_14, lag_30, lag_60 FROM feats"))
def lag_features(spark, sf_dir):
    df = features.lag_features(features.rolling_demand(fixtures.retail_panel(spark, sf_dir)))
    return df.select("date", *SERIES, "lag_7", "lag_14", "lag_30", "lag_60")


@query(
    "rolling_means",
    with_parts(
        "feats",
        f"""SELECT {KEY}, {r6('rolling_mean_7', 'rolling_mean_7')},
        {r6('rolling_mean_30', 'rolling_mean_30')} FROM feats""",
    ),
)
def rolling_means(spark, sf_dir):
    df = features.rolling_means(features.rolling_demand(fixtures.retail_panel(spark, sf_dir)))
    return rounded(df.select("date", *SERIES, "rolling_mean_7", "rolling_mean_30"))


@query(
    "calendar_features",
    with_parts("feats", f"SELECT {KEY}, week, month, is_weekend FROM feats"),
)
def calendar_features(spark, sf_dir):
    df = features.calendar_features(fixtures.retail_panel(spark, sf_dir))
    return df.select("date", *SERIES, "week", "month", "is_weekend")


@query(
    "log_target",
    with_parts(
        "feats",
        f"""SELECT {KEY}, {r6('log_units_sold_7d', 'log_units_sold_7d')},
        {r6('exp(log_units_sold_7d) - 1', 'unlogged')} FROM feats""",
    ),
)
def log_target(spark, sf_dir):
    df = features.rolling_demand(fixtures.retail_panel(spark, sf_dir))
    logged = df.withColumn("log_units_sold_7d", features.log_target("units_sold_7d"))
    return rounded(
        logged.select(
            "date", *SERIES, "log_units_sold_7d", F.expm1("log_units_sold_7d").alias("unlogged")
        )
    )


@query(
    "naive_diff",
    with_parts(
        "demand",
        f"""SELECT {KEY}, units_sold_7d - lag(units_sold_7d) OVER ({W}) AS naive_diff FROM demand""",
    ),
)
def naive_diff(spark, sf_dir):
    df = features.naive_diff(features.rolling_demand(fixtures.retail_panel(spark, sf_dir)))
    return df.select("date", *SERIES, "naive_diff")


FEATURE_SQL = f"""
SELECT {PANEL_ROUNDED}, units_sold_7d, {r6('log_units_sold_7d', 'log_units_sold_7d')},
  week, month, is_weekend, lag_7, lag_14, lag_30, lag_60,
  {r6('rolling_mean_7', 'rolling_mean_7')}, {r6('rolling_mean_30', 'rolling_mean_30')}
FROM feats"""


@query("create_features", with_parts("feats", FEATURE_SQL))
def create_features(spark, sf_dir):
    return rounded(features.create_features(fixtures.retail_panel(spark, sf_dir)))


@query("create_features_segmented", with_parts("feats", FEATURE_SQL))
def create_features_segmented(spark, sf_dir):
    return rounded(
        features.create_features(fixtures.retail_panel(spark, sf_dir), segment_rows=512)
    )


@query("bucketed_features", with_parts("feats", FEATURE_SQL))
def bucketed_features(spark, sf_dir):
    """Features of a panel saved in buckets, which no exchange moves again."""
    name = f"panel_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    buckets = max(8, fixtures.panel_tasks(spark, sf_dir))
    source.save_bucketed(fixtures.retail_panel(spark, sf_dir), name, buckets, path)
    return rounded(features.create_features(spark.table(name)))


# The last year arrives as a batch, with corrections of one product's sales in an earlier March.
LAST_YEAR = "date >= DATE '2001-01-01'"
CORRECTED = "product_id = 'PROMO' AND year(date) = 1999 AND month(date) = 3"


@query(
    "update_features",
    with_parts(
        "feats",
        f"""{FEATURE_SQL} JOIN (
  SELECT {S}, min(date) AS first_date FROM panel WHERE {LAST_YEAR} OR ({CORRECTED}) GROUP BY {S}) USING ({S})
WHERE date >= first_date""",
    )
    .replace("demand AS (", f"changed AS (SELECT * REPLACE (CAST(units_sold + CASE WHEN {CORRECTED} THEN 1 ELSE 0 END AS INT) AS units_sold) FROM panel),\ndemand AS (")
    .replace("AS units_sold_7d FROM panel", "AS units_sold_7d FROM changed"),
)
def update_features(spark, sf_dir):
    """Features after a batch from the state before it; one product has rows that come late."""
    panel = fixtures.retail_panel(spark, sf_dir)
    before = panel.filter(f"NOT ({LAST_YEAR})")
    corrected = before.filter(CORRECTED).withColumn("units_sold", F.col("units_sold") + 1)
    batch = panel.filter(LAST_YEAR).unionByName(corrected)
    found, _ = features.update_features(features.feature_state(before), batch, before)
    return rounded(found)


@query(
    "baseline_predict",
    with_parts("pred", f"SELECT {KEY}, actual, {r6('predicted', 'predicted')} FROM pred"),
)
def baseline_predict(spark, sf_dir):
    return rounded(fixtures.panel_pred(spark, sf_dir).select("date", *SERIES, "actual", "predicted"))


@query(
    "zero_lags",
    with_parts(
        "scenario",
        f"""SELECT {S}, CAST(week(DATE '{fixtures.TARGET_DATE}') AS INT) AS week,
        CAST(month(DATE '{fixtures.TARGET_DATE}') AS INT) AS month,
        CASE WHEN isodow(DATE '{fixtures.TARGET_DATE}') >= 6 THEN 1 ELSE 0 END AS is_weekend,
        {', '.join(f'CAST(0 AS DOUBLE) AS {name}' for name in LAG_COLUMNS)} FROM scenario""",
    ),
)
def zero_lags(spark, sf_dir):
    from ..operators.models import prepare_scenarios

    prepared = prepare_scenarios(fixtures.scenarios(spark, sf_dir), "zero")
    return prepared.select(*SERIES, "week", "month", "is_weekend", *LAG_COLUMNS)


# -- split and encoders -----------------------------------------------------


@query(
    "split_date",
    with_parts(
        "panel",
        f"""SELECT {r6("quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8)", 'split_day')}
        FROM panel""",
    ),
)
def split_date_all(spark, sf_dir):
    return rounded(split_date(fixtures.retail_panel(spark, sf_dir)))


@query(
    "split_date_by_store",
    with_parts(
        "panel",
        f"""SELECT store_id,
        {r6("quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8)", 'split_day')}
        FROM panel GROUP BY store_id""",
    ),
)
def split_date_by_store(spark, sf_dir):
    return rounded(split_date(fixtures.retail_panel(spark, sf_dir), by=["store_id"]))


@query("time_split", with_parts("split", f"SELECT {KEY}, split FROM split"))
def time_split(spark, sf_dir):
    return fixtures.panel_split(spark, sf_dir).select("date", *SERIES, "split")


@query(
    "split_sizes",
    with_parts(
        "split",
        f"""SELECT split, count(*) AS records,
        {r6('count(*) * 100.0 / sum(count(*)) OVER ()', 'share')} FROM split GROUP BY split""",
    ),
)
def split_sizes_all(spark, sf_dir):
    return rounded(split_sizes(fixtures.panel_split(spark, sf_dir)))


LABELS = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS "column", {name} AS label,
    CAST(row_number() OVER (ORDER BY {name}) - 1 AS INT) AS code
    FROM (SELECT DISTINCT {name} FROM panel)"""
    for name in CATEGORICALS
)


@query("fit_encoders", with_parts("panel", LABELS))
def fit_encoders(spark, sf_dir):
    panel = fixtures.retail_panel(spark, sf_dir)
    return encode.fit_encoders(panel).select("column", "label", "code")


CODES = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {name}) - 1 AS DOUBLE) AS {name}_idx" for name in CATEGORICALS
)


@query("encode", with_parts("panel", f"SELECT {KEY}, {CODES} FROM panel"))
def encode_panel(spark, sf_dir):
    panel = fixtures.retail_panel(spark, sf_dir)
    coded = encode.encode(panel, encode.fit_encoders(panel))
    return coded.select("date", *SERIES, *[f"{name}_idx" for name in CATEGORICALS])


@query(
    "feature_projection",
    with_parts(
        "feats",
        f"""SELECT {CODES.replace("CAST(dense_rank() OVER (ORDER BY weather_condition) - 1 AS DOUBLE) AS weather_condition_idx, ", "")},
        inventory_level, price, round(discount, 6) AS discount,
        round(competitor_pricing, 6) AS competitor_pricing, holiday_promotion, is_weekend, week, month,
        lag_7, lag_14, lag_30, lag_60, {r6('rolling_mean_7', 'rolling_mean_7')},
        {r6('rolling_mean_30', 'rolling_mean_30')} FROM feats""",
    ),
)
def feature_projection_of_panel(spark, sf_dir):
    panel = fixtures.retail_panel(spark, sf_dir)
    coded = encode.encode(panel, encode.fit_encoders(panel))
    return rounded(feature_projection(features.create_features(coded)))

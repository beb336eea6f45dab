"""Queries with trained models.

Keys, counts and inputs are checked exactly against SQL; of a model's figures the
properties that must hold: present, above the floor of the log target, and better
than the mean of what it was trained on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models
from ..operators.clean import clean_panel
from ..operators.encode import encode, fit_encoders
from ..operators.features import create_features
from ..plans.recommend import bulk_recommend, predict_scenarios, scored_history
from ..plans.training import train_and_report, train_stores
from ..schema import DATE, LABEL, SERIES, model_inputs
from ..session import ensure_checkpoint_dir, release_shuffles, stored
from ..sources import artifacts
from . import fixtures
from .fixtures import TARGET_DATE
from .oracle import with_parts
from .registry import query

# Boosting rounds of the registered queries; the library's default is 600. The README has the
# seconds a round takes. Depth, bins and all else are the defaults.
QUERY_ROUNDS = 30

_reports: dict = {}


def trained(spark, sf_dir):
    """The global model over the whole panel, trained once per application and folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _reports:
        report = train_and_report(fixtures.retail_panel(spark, sf_dir), maxIter=QUERY_ROUNDS)
        saved = report.saved.first()
        report.release()
        _reports[key] = (report.forecaster, saved)
    return _reports[key]


S = ", ".join(SERIES)
CLEAN = "panel WHERE units_sold >= 0 AND price > 0"


@query(
    "global_model_report",
    with_parts(
        "panel",
        f"""SELECT count(*) FILTER (WHERE date_diff('day', DATE '1970-01-01', date) <= day) AS train_records,
  count(*) FILTER (WHERE date_diff('day', DATE '1970-01-01', date) > day) AS valid_records,
  TRUE AS better_than_train_mean
FROM (SELECT * FROM {CLEAN}), (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS day FROM {CLEAN})""",
    ),
)
def global_model_report(spark, sf_dir):
    """Rows of both splits, and whether the model explains any of the training target."""
    _, saved = trained(spark, sf_dir)
    return spark.range(1).select(
        F.lit(saved.train_records).cast("long").alias("train_records"),
        F.lit(saved.valid_records).cast("long").alias("valid_records"),
        F.lit(saved.train_r2 > 0).alias("better_than_train_mean"),
    )


STAGES, STAGE_ROUNDS = 3, 2


@query(
    "global_model_stages",
    with_parts(
        "panel",
        f"""SELECT CAST(stage AS INT) AS stage, {STAGE_ROUNDS} AS rounds, records, TRUE AS better FROM range({STAGES}) AS s(stage), (
  SELECT count(*) FILTER (WHERE date_diff('day', DATE '1970-01-01', date) <= day) AS records
  FROM (SELECT * FROM {CLEAN}), (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS day FROM {CLEAN}))""",
    ),
)
def global_model_stages(spark, sf_dir):
    """Rounds and rows of each stage of a model whose training was cut off after two stages and went on."""
    clean = models.stored_panel(clean_panel(fixtures.retail_panel(spark, sf_dir)))
    featured = encode(create_features(models.by_series(clean)), fit_encoders(clean)).select(DATE, *model_inputs(), LABEL)
    path = f"{ensure_checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"
    train = stored(models.time_split(featured, panel=clean).filter(F.col("split") == "train"), "training")
    release_shuffles(spark)
    for stages in (STAGES - 1, STAGES):
        models.fit_global_stages(train, path, stages * STAGE_ROUNDS, STAGE_ROUNDS)
    left = F.lag("squared_error").over(Window.orderBy("stage"))
    better = F.coalesce(F.col("squared_error") < left, F.col("squared_error").isNotNull())
    return models.stage_table(spark, path).select("stage", "rounds", F.col("rows").alias("records"), better.alias("better"))


@query("global_model_history", with_parts(
    "panel",
    f"""SELECT date, {S}, CAST(sum(units_sold) OVER (PARTITION BY {S} ORDER BY date ROWS 6 PRECEDING) AS DOUBLE) AS actual,
  TRUE AS usable FROM panel""",
))
def global_model_history(spark, sf_dir):
    """Every row of the panel has a prediction above the floor of the log target."""
    forecaster, _ = trained(spark, sf_dir)
    scored = scored_history(fixtures.retail_panel(spark, sf_dir), forecaster)
    usable = F.col("predicted").isNotNull() & (F.col("predicted") > -1)
    return scored.select("date", *SERIES, "actual", usable.alias("usable"))


@query(
    "global_model_bulk",
    with_parts("panel", f"SELECT {S}, '{TARGET_DATE}' AS prediction_date, TRUE AS complete FROM panel GROUP BY {S}"),
)
def global_model_bulk(spark, sf_dir):
    """A complete row for every product of every store."""
    forecaster, _ = trained(spark, sf_dir)
    rows = bulk_recommend(fixtures.retail_panel(spark, sf_dir), TARGET_DATE, forecaster)
    complete = F.col("error").isNull() & F.col("status").isNotNull() & F.col("recommended_order").isNotNull()
    return rows.select(*SERIES, "prediction_date", complete.alias("complete"))


@query(
    "store_model_training",
    with_parts(
        "panel",
        f"SELECT store_id, count(*) AS records, TRUE AS measured FROM {CLEAN} GROUP BY store_id HAVING count(*) >= 100",
    ),
)
def store_model_training(spark, sf_dir):
    """Rows of every store with a model, and whether its error could be measured."""
    training = train_stores(fixtures.retail_panel(spark, sf_dir))
    rows = training.summary.select("store_id", "records", F.col("mae").isNotNull().alias("measured"))
    training.release()
    return rows


@query(
    "store_model_scenarios",
    with_parts(
        "panel",
        f"""SELECT {S}, DATE '{TARGET_DATE}' AS date, max(n) >= 100 AS predicted
FROM (SELECT *, count(*) OVER (PARTITION BY store_id) AS n FROM panel) GROUP BY {S}""",
    ),
)
def store_model_scenarios(spark, sf_dir):
    """Which scenarios have a prediction: those of stores with a model."""
    panel = fixtures.retail_panel(spark, sf_dir)
    training = train_stores(panel)
    scored = predict_scenarios(fixtures.scenarios(spark, sf_dir), training.forecaster)
    training.release()
    return scored.select(*SERIES, "date", F.col("predicted_weekly_demand").isNotNull().alias("predicted"))


@query(
    "training_rows",
    with_parts(
        "panel",
        f"""SELECT store_id, split, count(*) AS records FROM (
  SELECT store_id, CASE WHEN date_diff('day', DATE '1970-01-01', date) <= day THEN 'train' ELSE 'valid' END AS split
  FROM (SELECT * FROM {CLEAN}) JOIN (
    SELECT store_id, quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS day FROM {CLEAN}
    GROUP BY store_id HAVING count(*) >= 100) USING (store_id)) GROUP BY store_id, split""",
    ),
)
def training_rows(spark, sf_dir):
    """Training and validation rows of each store with enough of them, by its own split date."""
    clean = clean_panel(fixtures.retail_panel(spark, sf_dir))
    rows = models.training_rows(create_features(clean), clean)
    return rows.groupBy("store_id", "split").agg(F.count(F.lit(1)).alias("records"))


LABELLED = " UNION ALL ".join(
    f"SELECT store_id, '{c}' AS kind, {c} AS label, inventory_level, holiday_promotion, month, target FROM kept" for c in models.INDICATORS
)


@query(
    "store_model_sums",
    with_parts(
        "panel",
        f"""SELECT store_id, kind, label, count(*) AS records, CAST(sum(inventory_level) AS DOUBLE) AS inventory_sum,
  CAST(sum(holiday_promotion) AS DOUBLE) AS holiday_sum, CAST(sum(month) AS DOUBLE) AS month_sum,
  CAST(sum(month * inventory_level) AS DOUBLE) AS month_inventory_sum, round(sum(ln(1 + target)), 6) AS label_sum
FROM (WITH featured AS (
    SELECT *, month(date) AS month, sum(units_sold) OVER (PARTITION BY {S} ORDER BY date ROWS 6 PRECEDING) AS target FROM {CLEAN}),
  cut AS (SELECT store_id, quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.8) AS day FROM {CLEAN}
    GROUP BY store_id HAVING count(*) >= 100),
  kept AS (SELECT * FROM featured JOIN cut USING (store_id) WHERE date_diff('day', DATE '1970-01-01', date) <= day)
  {LABELLED}) GROUP BY store_id, kind, label""",
    ),
)
def store_model_sums(spark, sf_dir):
    """Each label's part of the stores' normal equations: rows, sums of inputs, of a product and of the label."""
    clean = clean_panel(fixtures.retail_panel(spark, sf_dir))
    featured = create_features(clean).withColumn("product_id_idx", F.lit(0.0))
    cells = models.store_cells(models.training_rows(featured, clean).filter("split = 'train'"))
    at = {name: k for k, name in enumerate((*models.STORE_INPUTS, LABEL))}
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    both = pairs.index(tuple(sorted((at["inventory_level"], at["month"]))))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in models.INDICATORS]))
    rows = cells.select("store_id", "n", "sums", "products", kinds.alias("of")).select("*", "of.*")
    return rows.groupBy("store_id", "kind", "label").agg(
        F.sum("n").alias("records"),
        F.sum(F.col("sums")[at["inventory_level"]]).alias("inventory_sum"),
        F.sum(F.col("sums")[at["holiday_promotion"]]).alias("holiday_sum"),
        F.sum(F.col("sums")[at["month"]]).alias("month_sum"),
        F.sum(F.col("products")[both]).alias("month_inventory_sum"),
        F.round(F.sum(F.col("sums")[at[LABEL]]), 6).alias("label_sum"),
    )


@query(
    "store_model_scores",
    with_parts(
        "panel",
        f"""SELECT date, {S}, round(exp(0.5 + 0.001 * price - 0.002 * inventory_level + 0.01 * month(date)
  + CASE category WHEN 'Core' THEN 0.25 WHEN 'Promo' THEN -0.125 ELSE 0 END + CASE seasonality WHEN 'Winter' THEN k ELSE 0 END) - 1, 6) AS predicted
FROM panel JOIN (SELECT store_id, count(*) / 10000.0 AS k FROM panel GROUP BY store_id) USING (store_id)""",
    ),
)
def store_model_scores(spark, sf_dir):
    """Every panel row scored with a table of given coefficients and label weights per store."""
    panel = fixtures.retail_panel(spark, sf_dir)
    given = {"price": 0.001, "inventory_level": -0.002, "month": 0.01}
    weights = F.map_from_arrays(
        F.array(*map(F.lit, ("category=Core", "category=Promo", "seasonality=Winter"))),
        F.array(F.lit(0.25), F.lit(-0.125), F.count(F.lit(1)) / 10000.0),
    )
    table = panel.groupBy("store_id").agg(
        F.array(F.lit(0.5), *[F.lit(given.get(name, 0.0)) for name in models.STORE_INPUTS]).alias("coefficients"), weights.alias("labels")
    )
    featured = create_features(panel).withColumn("product_id_idx", F.lit(0.0))
    return models.score_per_store(featured, table).select("date", *SERIES, F.round("predicted", 6).alias("predicted"))


# A log of one entry per store and month with sales, named and timed by the month.
LOG_SQL = """SELECT store_id, concat('m/', store_id, '/', strftime(date, '%Y%m')) AS model_path,
  concat('e/', strftime(date, '%Y%m')) AS encoder_path, round(avg(discount), 6) AS accuracy,
  CAST(date_trunc('month', date) AS TIMESTAMP) AS trained_at, count(*) AS record_count,
  CAST(sum(inventory_level) AS DOUBLE) AS size_mb FROM panel WHERE {months} GROUP BY ALL"""


def _log(panel):
    month = F.date_format("date", "yyyyMM").alias("month")
    grouped = panel.groupBy("store_id", month, F.date_trunc("month", F.col("date").cast("timestamp")).alias("trained_at"))
    return grouped.agg(
        F.round(F.avg("discount"), 6).alias("accuracy"), F.count(F.lit(1)).alias("record_count"),
        F.sum("inventory_level").cast("double").alias("size_mb"),
    ).withColumns({"model_path": F.concat(F.lit("m/"), "store_id", F.lit("/"), "month"), "encoder_path": F.concat(F.lit("e/"), "month")})


@query(
    "model_registry",
    with_parts(
        "panel",
        f"""SELECT store_id, model_path, encoder_path, accuracy, strftime(trained_at, '%Y-%m-%d') AS trained_at, record_count, size_mb
FROM ({LOG_SQL.format(months='TRUE')})
QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY trained_at DESC, model_path DESC) = 1""",
    ),
)
def model_registry(spark, sf_dir):
    """Each store's latest model, from a log that was appended to, compacted and appended to again."""
    log = _log(fixtures.retail_panel(spark, sf_dir))
    path = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    artifacts.register_models(log.filter("month < '199801'"), path)
    artifacts.register_models(log.filter("month >= '199801' and month < '200001'"), path)
    artifacts.compact_registry(spark, path)
    artifacts.register_models(log.filter("month >= '200001'"), path)
    latest = artifacts.model_registry(artifacts.read_registry(spark, path))
    return latest.withColumn("trained_at", F.date_format("trained_at", "yyyy-MM-dd"))


@query(
    "unused_folders",
    with_parts(
        "panel",
        f"""SELECT folder FROM (WITH entries AS ({LOG_SQL.format(months='TRUE')}),
  latest AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY trained_at DESC, model_path DESC) = 1)
  SELECT model_path AS folder FROM entries UNION SELECT encoder_path FROM entries
  EXCEPT (SELECT model_path FROM latest UNION SELECT encoder_path FROM latest))""",
    ),
)
def unused_folders(spark, sf_dir):
    """Folders of models that a later one of their store has replaced, and of encoders that no latest one needs."""
    return artifacts.unused_folders(_log(fixtures.retail_panel(spark, sf_dir))).select("folder")

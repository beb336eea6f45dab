"""Encoders, models, forecasters and the training and report plans."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures
from shelfcast.operators import models
from shelfcast.operators.clean import UnknownStore, store_filter
from shelfcast.operators.encode import encode, fit_encoders
from shelfcast.operators.features import create_features
from shelfcast.operators.models import StoreForecaster, solve_ridge
from shelfcast.plans.evaluation import evaluation_report
from shelfcast.plans.recommend import bulk_recommend, bulk_summary, recommend
from shelfcast.plans.reorder import reorder_report
from shelfcast.plans.training import train_and_report, train_stores
from shelfcast.schema import CATEGORICALS, LABEL, LAG_COLUMNS, model_inputs
from shelfcast.sources import artifacts

ROUNDS = {"maxIter": 3, "maxDepth": 4}


@pytest.fixture(scope="module")
def panel(spark):
    return fixtures.retail_panel(spark, SMALL).cache()


@pytest.fixture(scope="module")
def trained(spark, panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    return path, train_and_report(panel, path, **ROUNDS)


@pytest.fixture(scope="module")
def stores(spark, panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stores"))
    return path, train_stores(panel, path)


def test_codes_decode_to_their_labels(spark, panel):
    encoders = fit_encoders(panel)
    coded = encode(panel, encoders)
    for name in CATEGORICALS:
        table = encoders.filter(F.col("column") == name)
        labels = [r.label for r in table.orderBy("code").collect()]
        assert labels == sorted(labels)
        wrong = coded.filter(
            F.col(name) != F.element_at(F.array(*map(F.lit, labels)), (F.col(f"{name}_idx") + 1).cast("int"))
        )
        assert wrong.count() == 0


def test_unseen_labels(spark, panel):
    encoders = fit_encoders(panel.filter("category != 'Promo'"), ["category"])
    columns = ["category"]
    with pytest.raises(Exception, match="unseen label in category: Promo"):
        encode(panel, encoders, columns).collect()
    assert encode(panel, encoders, columns, "skip").filter("category = 'Promo'").count() == 0
    kept = encode(panel, encoders, columns, "keep").filter("category = 'Promo'")
    assert [r[0] for r in kept.select("category_idx").distinct().collect()] == [2.0]


def test_global_model_beats_the_mean(trained):
    valid = trained[1].valid.collect()[0]
    assert valid.mae < valid.std_actual * 0.8 and valid.mase is not None


def test_global_model_is_repeatable(panel, trained):
    again = train_and_report(panel, **ROUNDS).valid.collect()[0]
    assert again.mae == pytest.approx(trained[1].valid.collect()[0].mae, rel=1e-9)


def test_saved_model_scores_alike(spark, panel, trained):
    path, report = trained
    model, encoders = artifacts.load_model(spark, f"{path}/GLOBAL")
    featured = create_features(panel)
    loaded = models.GlobalForecaster(model, encoders).score_history(featured)
    fresh = report.forecaster.score_history(featured)
    keys = ["date", "store_id", "product_id", "predicted"]
    assert loaded.select(keys).exceptAll(fresh.select(keys)).count() == 0


def test_saved_metrics_and_registry(spark, trained):
    path, report = trained
    saved = artifacts.load_metrics(spark, f"{path}/metrics").collect()[0]
    assert saved.primary_metric == "WAPE"
    assert saved.valid_mae == pytest.approx(report.valid.collect()[0].mae)
    listed = artifacts.model_registry(artifacts.read_registry(spark, f"{path}/registry")).collect()
    assert [r.store_id for r in listed] == ["GLOBAL"] and listed[0].size_mb > 0


def test_gap_between_splits(trained):
    gap = trained[1].gap.collect()[0]
    train, valid = trained[1].train.collect()[0], trained[1].valid.collect()[0]
    assert gap.mae_gap == pytest.approx(valid.mae - train.mae)


def test_store_models_equal_a_direct_solution(spark, panel, stores):
    _, training = stores
    encoders = fit_encoders(panel)
    rows = models.training_rows(create_features(encode(panel, encoders)), panel)
    numeric = list(models.STORE_INPUTS)
    table = rows.filter("split = 'train' and store_id = 'S00001'").select(*numeric, *models.INDICATORS, LABEL).toPandas()
    names = sorted(f"{c}={v}" for c in models.INDICATORS for v in table[c].unique())
    assert len(names) > 6
    ones = [(table[n.split("=")[0]] == n.split("=")[1]).to_numpy(float) for n in names]
    x, y = np.column_stack([table[numeric].to_numpy(float), *ones]), table[LABEL].to_numpy(float)
    spread = x.std(axis=0)
    use = spread > 1e-9
    z = (x[:, use] - x[:, use].mean(axis=0)) / spread[use]
    beta = np.linalg.solve(z.T @ z / len(y) + 0.01 * np.eye(use.sum()), z.T @ (y - y.mean()) / len(y))
    expected = np.zeros(x.shape[1])
    expected[use] = beta / spread[use]
    got = training.coefficients.filter("store_id = 'S00001'").collect()[0]
    assert np.allclose(got.coefficients[1:], expected[: len(numeric)], rtol=1e-6, atol=1e-9)
    assert sorted(got.labels) == names
    assert np.allclose([got.labels[n] for n in names], expected[len(numeric) :], rtol=1e-6, atol=1e-9)
    assert got.coefficients[0] == pytest.approx(y.mean() - expected @ x.mean(axis=0))


def test_another_label_changes_the_prediction_by_its_weight(panel, stores):
    _, training = stores
    rows = create_features(encode(panel.filter("store_id = 'S00001'"), fit_encoders(panel), ("product_id",)))
    rows = rows.withColumn("category", F.lit("Core"))
    weights = training.coefficients.filter("store_id = 'S00001'").collect()[0].labels
    assert abs(weights["category=Promo"] - weights["category=Core"]) > 1e-6

    def logs(category):
        scored = models.score_per_store(rows.withColumn("category", F.lit(category)), training.coefficients)
        return np.log1p([r.predicted for r in scored.orderBy("product_id", "date").collect()])

    change = logs("Promo") - logs("Core")
    assert np.allclose(change, weights["category=Promo"] - weights["category=Core"])
    # A label the store has never had weighs nothing.
    assert np.allclose(logs("Other") - logs("Core"), -weights["category=Core"])


def test_store_summary_and_registry(spark, stores):
    path, training = stores
    summary = training.summary.collect()
    assert len(summary) == 10 and all(r.accuracy > 50 for r in summary)
    listed = artifacts.model_registry(artifacts.read_registry(spark, f"{path}/registry"))
    assert listed.count() == 10
    coefficients, encoders = artifacts.load_store_models(spark, f"{path}/stores")
    assert coefficients.count() == 10 and encoders.count() > 10


def test_small_stores_are_not_trained(panel):
    assert train_stores(panel, min_rows=600).summary.count() < 10


def test_one_store_with_most_rows(spark, panel):
    hot = panel.filter("store_id = 'S00001'")
    copies = spark.range(1, 20).select(F.col("id").alias("n"))
    more = hot.crossJoin(copies).withColumn("product_id", F.concat("product_id", F.lit("-"), "n")).drop("n")
    summary = train_stores(panel.unionByName(more)).summary
    records = {r.store_id: r.records for r in summary.collect()}
    assert records["S00001"] == 20 * hot.count() and len(records) == 10


@pytest.mark.parametrize("kind", ["baseline", "global", "store"])
def test_every_forecaster_serves_every_plan(spark, panel, trained, stores, kind):
    forecaster = {
        "baseline": models.BaselineForecaster(),
        "global": trained[1].forecaster,
        "store": stores[1].forecaster,
    }[kind]
    rows = bulk_recommend(panel, "2001-12-03", forecaster, stores="S00002")
    assert rows.count() == 6
    total = bulk_summary(rows).collect()[0]
    assert total.total_products == 6
    assert total.critical_stock + total.low_stock + total.adequate_stock + total.excess_stock == 6
    wanted = fixtures.scenarios(spark, SMALL).filter("product_id = 'PROMO'")
    assert recommend(wanted, panel, forecaster).count() == 10


def test_scenarios_with_zero_and_carried_lags(spark, panel):
    latest = create_features(panel).filter("date = '2001-10-01'")
    wanted = latest.select("store_id", "product_id", "date")
    zero = models.prepare_scenarios(wanted).collect()[0]
    assert all(zero[name] == 0.0 for name in LAG_COLUMNS)
    carried = models.prepare_scenarios(wanted, "carry", latest)
    assert carried.select(*LAG_COLUMNS).exceptAll(latest.select(*LAG_COLUMNS)).count() == 0


def test_bulk_needs_a_date(panel):
    with pytest.raises(ValueError):
        bulk_recommend(panel, "", models.BaselineForecaster())


def test_feature_projection_order(spark, panel):
    coded = create_features(encode(panel, fit_encoders(panel)))
    assert models.feature_projection(coded).columns == model_inputs()
    assert "weather_condition_idx" not in model_inputs()


def test_reports_are_saved(spark, panel, trained, tmp_path):
    baseline = models.BaselineForecaster()
    report = reorder_report(panel, baseline, str(tmp_path / "reorders"))
    written = spark.read.option("header", True).csv(str(tmp_path / "reorders"))
    assert written.count() == report["reorders"].count() > 0
    saved = trained[1].saved
    sections = evaluation_report(panel, baseline, saved, str(tmp_path / "evaluation"), "r1")
    assert sections["drift"].count() == 1
    for name in ("overall", "by_store", "by_category", "by_month", "error_percentiles"):
        back = artifacts.load_evaluation(spark, str(tmp_path / "evaluation"), "r1", name)
        assert back.count() == sections[name].count() > 0
    detail = spark.read.option("header", True).csv(str(tmp_path / "evaluation/run_id=r1/detail"))
    assert detail.count() == panel.count()


@pytest.mark.parametrize("rows", [1_000, 6_000])
def test_constant_inputs_get_no_coefficient(rows):
    rng = np.random.default_rng(rows)
    x = np.column_stack([np.full(rows, 12.34), rng.normal(5, 2, rows), np.full(rows, -0.1)])
    y = 3.0 + 0.5 * x[:, 1]
    values = np.column_stack([x, y])
    low = values.min(axis=0)
    shifted = np.column_stack([np.ones(rows), values - low])
    sums = (shifted.T @ shifted)[np.triu_indices(5)]
    got = solve_ridge(sums, low, 3, 1e-9)
    assert got[1] == 0 and got[3] == 0
    assert got[2] == pytest.approx(0.5) and got[0] == pytest.approx(3.0)


def test_retraining_one_store_keeps_the_others(spark, panel, tmp_path):
    path = str(tmp_path / "models")
    train_stores(panel, path).release()
    before = artifacts.load_store_models(spark, f"{path}/stores")
    scored = StoreForecaster(*before).score_history(create_features(panel.limit(0).unionByName(panel)))
    first = {(r.date, r.store_id, r.product_id): r.predicted for r in scored.collect()}
    train_stores(panel.filter("store_id = 'S00001'").withColumn("units_sold", F.col("units_sold") + 5), path).release()
    coefficients, encoders = artifacts.load_store_models(spark, f"{path}/stores")
    assert coefficients.count() == 10 and coefficients.select("run_id").distinct().count() == 2
    again = StoreForecaster(coefficients, encoders).score_history(create_features(panel)).collect()
    changed = {r.store_id for r in again if r.predicted != first[(r.date, r.store_id, r.product_id)]}
    assert changed == {"S00001"}
    registry = artifacts.model_registry(artifacts.read_registry(spark, f"{path}/registry")).collect()
    assert len(registry) == 10 and all(0 < r.size_mb < 0.01 for r in registry)


def test_an_unseen_label_fails_its_rows_only(panel):
    training = train_stores(panel)
    seen = panel.withColumn("region", F.when(F.col("product_id") == panel.first().product_id, "elsewhere").otherwise(F.col("region")))
    rows = bulk_recommend(seen, "1999-01-01", training.forecaster)
    failed = rows.filter("error is not null")
    assert 0 < failed.count() < rows.count()
    assert failed.filter("status is not null or recommended_order is not null").isEmpty()
    assert bulk_summary(rows).agg(F.sum("failed_products")).first()[0] == failed.count()
    training.release()


def test_an_unknown_store_is_an_error(panel):
    with pytest.raises(UnknownStore):
        store_filter(panel, "nowhere")


SMALL_TREES = {"maxDepth": 3, "maxBins": 32}


@pytest.fixture(scope="module")
def train_split(panel):
    featured = create_features(encode(panel, fit_encoders(panel)))
    return models.time_split(featured, panel=panel).filter("split = 'train'").cache()


def log_error(model, rows):
    scored = models.score_encoded(rows, model)
    return scored.agg(F.avg((F.log1p("predicted") - F.col(LABEL)) ** 2)).first()[0]


def test_stages_go_on_where_a_run_stopped(spark, train_split, tmp_path, monkeypatch):
    path = str(tmp_path / "stages")
    fitted = []
    fit = models.GBTRegressor.fit

    def fit_or_fail(self, rows):
        fitted.append(1)
        if len(fitted) == 3:
            raise RuntimeError("the driver is gone")
        return fit(self, rows)

    monkeypatch.setattr(models.GBTRegressor, "fit", fit_or_fail)
    with pytest.raises(RuntimeError, match="gone"):
        models.fit_global_stages(train_split, path, 6, 2, **SMALL_TREES)
    model = models.fit_global_stages(train_split, path, 6, 2, **SMALL_TREES)
    assert len(fitted) == 4
    table = models.stage_table(spark, path).collect()
    assert [(r.stage, r.rounds, r.rows) for r in table] == [(k, 2, train_split.count()) for k in range(3)]
    assert log_error(model, train_split) == pytest.approx(table[-1].squared_error)
    # All stages are there: nothing is trained.
    again = models.fit_global_stages(train_split, path, 6, 2, **SMALL_TREES)
    assert len(fitted) == 4 and log_error(again, train_split) == pytest.approx(table[-1].squared_error)
    whole = models.fit_global_stages(train_split, str(tmp_path / "other"), 6, 2, **SMALL_TREES)
    assert log_error(whole, train_split) == pytest.approx(table[-1].squared_error, rel=0.02)
    with pytest.raises(ValueError, match="other settings"):
        models.fit_global_stages(train_split, path, 6, 2, maxDepth=2, maxBins=32)
    with pytest.raises(ValueError, match="other settings"):
        models.fit_global_stages(train_split.limit(10), path, 6, 2, **SMALL_TREES)


def test_stages_are_as_good_as_a_single_run(panel, train_split, tmp_path):
    one = log_error(models.fit_global(train_split, maxIter=10, **SMALL_TREES), train_split)
    path = str(tmp_path / "m")
    report = train_and_report(panel, path, stage_rounds=5, maxIter=10, **SMALL_TREES)
    # Stated bound: two stages leave at most a tenth more squared error than one run of as many rounds.
    assert log_error(report.model, train_split) <= 1.1 * one
    loaded, _ = artifacts.load_model(panel.sparkSession, f"{path}/GLOBAL")
    assert log_error(loaded, train_split) == pytest.approx(log_error(report.model, train_split))
    report.release()

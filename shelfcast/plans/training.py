"""Train the global model or one model per store, and report on it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import np_round, ratio
from ..operators.clean import MIN_STORE_ROWS, clean_panel
from ..operators.encode import encode, fit_encoders
from ..operators.features import create_features
from ..operators.metrics import all_metrics, assessment, generalization_gap
from ..operators.models import (
    GLOBAL_PARAMS,
    INDICATORS,
    STORE_INPUTS,
    GlobalForecaster,
    StoreForecaster,
    by_series,
    fit_global,
    fit_global_stages,
    fit_per_store,
    score_encoded,
    score_per_store,
    split_date,
    split_text,
    stored_panel,
    time_split,
    training_rows,
)
from ..schema import DATE, LABEL, SERIES, TARGET, model_inputs
from ..session import release_shuffles, stored
from ..sources.artifacts import (
    GLOBAL_STORE,
    path_size_mb,
    register_models,
    save_metrics,
    save_model,
    save_store_models,
    saved_metrics_row,
)


@dataclass
class TrainingReport:
    model: PipelineModel
    encoders: DataFrame
    train: DataFrame
    valid: DataFrame
    gap: DataFrame
    saved: DataFrame
    rows: DataFrame

    @property
    def forecaster(self) -> GlobalForecaster:
        return GlobalForecaster(self.model, self.encoders)

    def release(self) -> None:
        """Drop the training rows if they were cached; stored ones stay for the frames that read them."""
        self.rows.unpersist()


def split_metrics(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of the train and the valid rows; MASE is scaled by the train rows."""
    train = scored.filter(F.col("split") == "train")
    valid = scored.filter(F.col("split") == "valid")
    return (
        assessment(all_metrics(train, "actual", "predicted")),
        assessment(all_metrics(valid, "actual", "predicted", train=train)),
    )


def training_record(scored: DataFrame, panel: DataFrame) -> DataFrame:
    """The metrics row a run saves, from rows that carry split and prediction."""
    train, valid = split_metrics(scored)
    cut = split_date(panel).select(split_text(F.col("split_day")).alias("split_date"))
    return saved_metrics_row(train, valid, cut)


def train_and_report(
    panel: DataFrame, path: str | None = None, stage_rounds: int | None = None, **params
) -> TrainingReport:
    """Clean, encode, build features, split by time, fit, measure and save.

    With ``stage_rounds`` the model is trained in stages saved below ``path``, and a
    run that was cut off goes on behind the last finished one when it is started again.
    """
    if stage_rounds is not None and path is None:
        raise ValueError("stages need a folder")
    clean = stored_panel(clean_panel(panel))
    encoders = fit_encoders(clean)
    featured = time_split(encode(create_features(by_series(clean)), encoders), panel=clean)
    # Read by the fit and by the scores.
    featured = stored(featured.select(DATE, *SERIES, *model_inputs(), LABEL, TARGET, "split"), "training")
    release_shuffles(panel.sparkSession)
    train = featured.filter(F.col("split") == "train")
    if stage_rounds is None:
        model = fit_global(train, **params)
    else:
        rounds = params.pop("maxIter", GLOBAL_PARAMS["maxIter"])
        model = fit_global_stages(train, f"{path}/{GLOBAL_STORE}/stages", rounds, stage_rounds, **params)
    # Every figure of the report reads the scores.
    scored = score_encoded(featured, model).withColumn("actual", F.col(TARGET))
    scored = stored(scored.select(DATE, *SERIES, "split", "actual", "predicted"), "scores")
    train, valid = split_metrics(scored)
    saved = training_record(scored, clean)
    if path is not None:
        save_model(model, encoders, f"{path}/{GLOBAL_STORE}")
        save_metrics(saved, f"{path}/metrics")
        register_global(saved, path)
    gap = generalization_gap(train, valid)
    return TrainingReport(model, encoders, train, valid, gap, saved, featured)


def register_global(saved: DataFrame, path: str) -> None:
    spark = saved.sparkSession
    entry = saved.select(
        F.lit(GLOBAL_STORE).alias("store_id"),
        F.lit(f"{path}/{GLOBAL_STORE}/model").alias("model_path"),
        F.lit(f"{path}/{GLOBAL_STORE}/encoders").alias("encoder_path"),
        F.col("valid_wape_accuracy").alias("accuracy"),
        (F.col("train_records") + F.col("valid_records")).alias("record_count"),
        F.lit(path_size_mb(spark, f"{path}/{GLOBAL_STORE}/model")).alias("size_mb"),
    )
    register_models(entry, f"{path}/registry")


@dataclass
class StoreTraining:
    coefficients: DataFrame
    encoders: DataFrame
    summary: DataFrame
    rows: DataFrame

    @property
    def forecaster(self) -> StoreForecaster:
        return StoreForecaster(self.coefficients, self.encoders)

    def release(self) -> None:
        """Drop the training rows if they were cached; stored ones stay for the frames that read them."""
        self.rows.unpersist()


def training_summary(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows of each trained store, and MAE and accuracy on ``scored``, its validation rows."""
    mae = F.avg(F.abs(F.col("predicted") - F.col("actual")))
    errors = scored.groupBy("store_id").agg(
        np_round(mae, 2).alias("mae"),
        np_round((1.0 - ratio(mae, F.avg("actual"))) * 100.0, 1).alias("accuracy"),
    )
    return rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("records")).join(errors, "store_id", "left")


def train_stores(
    panel: DataFrame,
    path: str | None = None,
    min_rows: int = MIN_STORE_ROWS,
    penalty: float = 0.01,
) -> StoreTraining:
    """A model for every store with enough rows, all fitted in one job.

    For a single store, filter the panel first: a run saves its models under its
    own id, and other stores keep the models of their latest runs.
    """
    clean = stored_panel(clean_panel(panel))
    encoders = fit_encoders(clean)
    # Category, region and season enter by label; only products need a code.
    featured = encode(create_features(by_series(clean)), encoders, ("product_id",))
    rows = training_rows(featured, clean, min_rows, with_low=True, series_joined=True)
    # Read by the fit and by the scores; a caller may evaluate the summary long after this call.
    rows = stored(rows.select("store_id", "split", "_low", *INDICATORS, *STORE_INPUTS, LABEL, TARGET), "training")
    release_shuffles(panel.sparkSession)
    coefficients = stored(fit_per_store(rows.filter(F.col("split") == "train"), penalty), "coefficients")
    release_shuffles(panel.sparkSession)
    if path is not None:
        run_id = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
        save_store_models(coefficients, encoders, f"{path}/stores", run_id)
        coefficients = panel.sparkSession.read.parquet(f"{path}/stores/coefficients/run_id={run_id}")
    valid = rows.filter(F.col("split") == "valid")
    scored = score_per_store(valid, coefficients).withColumn("actual", F.col(TARGET))
    summary = training_summary(rows, scored)
    if path is not None:
        entries = summary.select(
            "store_id",
            F.lit(f"{path}/stores/coefficients/run_id={run_id}").alias("model_path"),
            F.lit(f"{path}/stores/encoders/run_id={run_id}").alias("encoder_path"),
            "accuracy",
            F.col("records").alias("record_count"),
            # A store's model is its coefficients, eight bytes each; weights of labels are not counted.
            F.lit(round((len(STORE_INPUTS) + 1) * 8 / (1024 * 1024), 6)).alias("size_mb"),
        )
        register_models(entries, f"{path}/registry")
    return StoreTraining(coefficients, encoders, summary, rows)

"""Saved models, their registry, and saved metrics."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITIES

GLOBAL_STORE = "GLOBAL"

# Metrics kept for each split after training.
SPLIT_METRICS = (
    "mae",
    "rmse",
    "r2",
    "mape",
    "smape",
    "wape",
    "mape_accuracy",
    "smape_accuracy",
    "wape_accuracy",
    "zero_records",
    "zero_percentage",
)


def save_model(model: PipelineModel, encoders: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    encoders.write.mode("overwrite").parquet(f"{path}/encoders")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/encoders")


def save_store_models(coefficients: DataFrame, encoders: DataFrame, path: str, run_id: str) -> None:
    """Write a run's coefficients and encoders under its own id; other runs stay.

    Run ids must sort by time; saving one again replaces that run only.
    """
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients/run_id={run_id}")
    encoders.write.mode("overwrite").parquet(f"{path}/encoders/run_id={run_id}")


def load_store_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Each store's model of its latest run, and the encoders of all runs.

    Both carry ``run_id``: a model is scored with the codes it was trained with.
    """
    models = spark.read.parquet(f"{path}/coefficients").withColumn("run_id", F.col("run_id").cast("string"))
    fields = [name for name in models.columns if name != "store_id"]
    latest = models.groupBy("store_id").agg(F.max_by(F.struct(*fields), "run_id").alias("_model"))
    encoders = spark.read.parquet(f"{path}/encoders").withColumn("run_id", F.col("run_id").cast("string"))
    return latest.select("store_id", "_model.*"), encoders


def saved_metrics_row(train: DataFrame, valid: DataFrame, split: DataFrame) -> DataFrame:
    """The one-row record of a training run, from the two splits' metrics.

    ``train`` and ``valid`` are one-row metric frames and ``split`` holds the
    split date, so the joins below have one row on each side.
    """
    left = train.select(
        *[F.col(name).alias(f"train_{name}") for name in SPLIT_METRICS],
        F.col("total_records").alias("train_records"),
    )
    right = valid.select(
        *[F.col(name).alias(f"valid_{name}") for name in (*SPLIT_METRICS, "mase")],
        F.col("total_records").alias("valid_records"),
        F.col("wape_accuracy").alias("primary_accuracy"),
        F.lit("WAPE").alias("primary_metric"),
    )
    one = F.lit(1).alias("_run")
    return (
        left.select("*", one)
        .join(right.select("*", one), "_run")
        .join(split.select("split_date", one), "_run")
        .drop("_run")
    )


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The latest saved metrics row."""
    return spark.read.parquet(path).orderBy(F.col("saved_at").desc()).limit(1)


def save_evaluation(sections: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write each section of an evaluation under one run id."""
    for name, section in sections.items():
        section.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/section={name}")


def load_evaluation(spark: SparkSession, path: str, run_id: str, section: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run_id={run_id}/section={section}")


def path_size_mb(spark: SparkSession, path: str) -> float:
    """Size of a saved model on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return round(files.getContentSummary(target).getLength() / (1024 * 1024), 2)


# -- registry: a log of trained models ----------------------------------------

REGISTRY = ENTITIES["trained_model"]


def register_models(models: DataFrame, path: str) -> None:
    """Append trained models to the registry's log, stamped with the training time if they have none."""
    now = F.current_timestamp() if "trained_at" not in models.columns else F.col("trained_at").cast("timestamp")
    columns = [now.alias(f.name) if f.name == "trained_at" else F.col(f.name).cast(f.dataType) for f in REGISTRY.fields]
    models.select(columns).write.parquet(f"{path}/part=log-{uuid.uuid4().hex}")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The whole log, compacted or not."""
    return spark.read.schema(REGISTRY).parquet(f"{path}/part=*")


def _parts(spark: SparkSession, path: str) -> list:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath() for status in files.listStatus(target) if status.getPath().getName().startswith("part=")]


def compact_registry(spark: SparkSession, path: str) -> int:
    """Replace the log's parts by one with a row per store; gives the number of parts it replaced.

    The new part is complete before the old ones go, and a reader that sees both
    finds the same latest models. Parts that are added meanwhile stay. What
    folders no store uses any more must be asked before (:func:`unused_folders`).
    """
    old = _parts(spark, path)
    if not old:
        return 0
    latest = latest_models(spark.read.schema(REGISTRY).parquet(*[part.toString() for part in old]))
    latest.select(*REGISTRY.names).write.parquet(f"{path}/part=compact-{uuid.uuid4().hex}")
    for part in old:
        part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)
    return len(old)


def latest_models(registry: DataFrame) -> DataFrame:
    """Each store's latest model; of models of the same time the one with the last path."""
    fields = [name for name in REGISTRY.names if name != "store_id"]
    latest = registry.groupBy("store_id").agg(
        F.max_by(F.struct(*fields), F.struct("trained_at", "model_path")).alias("latest")
    )
    return latest.select("store_id", "latest.*")


def unused_folders(registry: DataFrame, before: str | None = None) -> DataFrame:
    """Model and encoder folders that no store's latest model uses, and when they were last written.

    Stores of a run share its folders, so one stays as long as any store uses
    it. ``before`` keeps folders written at that time or later, as for runs that are still going on.
    """

    def folders(models: DataFrame) -> DataFrame:
        both = F.explode(F.array("model_path", "encoder_path")).alias("folder")
        return models.select(both, "trained_at").groupBy("folder").agg(F.max("trained_at").alias("trained_at"))

    used = folders(latest_models(registry)).select("folder")
    unused = folders(registry).join(used, "folder", "left_anti").filter(F.col("folder").isNotNull())
    return unused if before is None else unused.filter(F.col("trained_at") < F.lit(before).cast("timestamp"))


def expire_runs(spark: SparkSession, path: str, before: str | None = None) -> int:
    """Delete the folders of :func:`unused_folders`; gives their number.

    Without ``before`` nothing unused is left, and the log is compacted too. Folders
    are few, one or two for each run, and are gone through one at a time.
    """
    gone = 0
    for row in unused_folders(read_registry(spark, path), before).toLocalIterator():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row.folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        gone += 1
    if before is None:
        compact_registry(spark, path)
    return gone


def model_registry(registry: DataFrame) -> DataFrame:
    """The latest model of each store; the global one comes last."""
    return latest_models(registry).orderBy(F.col("store_id") == GLOBAL_STORE, "store_id")

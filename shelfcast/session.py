"""Session settings the engine relies on, and the one way it cuts lineage.

On a cluster set ``spark.sql.shuffle.partitions`` (or the adaptive initial
number) so that a partition of the panel's one large shuffle holds some 200 MB.
Adaptive execution merges partitions that turn out smaller.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffle partitions at run time and splits skewed join sides; the
# session zone is pinned so that dates never move with the machine.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when the frames that read them are given up.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "shelfcast", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="shelfcast-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there.

    Used where later steps depend on the exact row placement of an earlier one,
    which a recomputation after an executor loss could change.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read on from there.

    Unlike after :func:`durable`, later steps read only the columns they use, and
    Catalyst knows the true size, so it broadcasts the table only while that is small.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/shelfcast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now.

    It does so when the driver collects its garbage, which a driver with
    little to do may put off until after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Of the rows that a task hands to Python, and gets back, at a time. By Spark's own limits (10,000 rows,
# 64 MB) this may be a whole partition of texts, which the JVM and the worker then hold several times over.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``; no result depends on where they end."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Spark's own file server hands the archive to every executor, also to those
    that start later. Where the package is installed on the executors already,
    the archive is an equal copy.
    """
    context = spark.sparkContext
    if getattr(context, "_shelfcast_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="shelfcast-package-")) / "shelfcast-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, f"{root.name}/{file.relative_to(root).as_posix()}")
    context.addPyFile(str(archive))
    context._shelfcast_shipped = True

"""Ingest upload files as they arrive, with the batch upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.panel import ingest_batch


def ingest_arrivals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    landing: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Land every new upload file once, then stop.

    Each micro-batch becomes a partition of ``landing`` named by its number, so
    a batch that is run again after a failure replaces its own rows only.
    Readers apply :func:`~shelfcast.sources.panel.keep_last` over the partitions.
    """

    def land(batch: DataFrame, number: int) -> None:
        ingest_batch(batch, landing, f"stream-{number:010d}")

    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (
        reader.load(source)
        .writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

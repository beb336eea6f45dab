"""Typed readers and writers for the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITIES

# The column each table stamps when its rows are written.
AUDIT_COLUMNS = {
    "inventory": "updated_at",
    "forecast": "created_at",
    "reorder": "created_at",
    "uploaded_data": "uploaded_at",
    "trained_model": "trained_at",
}


def read_entity(
    spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read a table with its declared column types.

    ``fmt="jdbc"`` takes the usual options; give ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` so it reads in parallel.
    """
    schema = ENTITIES[name]
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        df = reader.load()
    else:
        df = reader.schema(schema).load(path)
    return df.select([F.col(field.name).cast(field.dataType) for field in schema.fields])


def stamp(df: DataFrame, name: str) -> DataFrame:
    column = AUDIT_COLUMNS.get(name)
    return df if column is None else df.withColumn(column, F.current_timestamp())


def write_entity(
    df: DataFrame, name: str, path: str, fmt: str = "parquet", mode: str = "append"
) -> None:
    """Project to the declared columns, stamp the load time, write."""
    stamped = stamp(df, name)
    columns = [F.col(field.name).cast(field.dataType) for field in ENTITIES[name].fields]
    stamped.select(columns).write.format(fmt).mode(mode).save(path)

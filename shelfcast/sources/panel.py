"""Read, validate, ingest and write the daily sales panel."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE, PANEL, REQUIRED_COLUMNS, SERIES
from ..session import ensure_checkpoint_dir

# Accepted spellings of a date, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
)
PANEL_KEY = (DATE, *SERIES)
ROW_ORDER = "_row_order"

REORDER_COLUMNS = (
    "store_id",
    "product_id",
    "inventory_level",
    "predicted_weekly_demand",
    "reorder_point",
    "order_quantity",
    "stockout_risk",
)
EVALUATION_COLUMNS = (
    "date",
    "store_id",
    "product_id",
    "actual",
    "predicted",
    "error",
    "abs_error",
    "pct_error",
)


class MissingColumns(ValueError):
    """An upload lacks required columns; ``columns`` names them."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        super().__init__(f"Missing required columns: {', '.join(self.columns)}")


def normalize_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("/", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(name) for name in df.columns])


def validate_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise MissingColumns(missing)
    return df


def parsed_date(text: Column, strict: bool = False) -> Column:
    """Text to date. Unreadable text gives null, or an error when ``strict``."""
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMATS])
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp")
        parsed = F.when(text.isNotNull() & parsed.isNull(), bad).otherwise(parsed)
    return parsed.cast("date")


def parse_dates(df: DataFrame, column: str = DATE, strict: bool = False) -> DataFrame:
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.StringType):
        value = parsed_date(F.trim(value), strict)
    return df.withColumn(column, value.cast("date"))


def cast_columns(df: DataFrame, schema: T.StructType = PANEL) -> DataFrame:
    """Give known columns their panel type; unreadable values and NaN become null.

    Columns the panel does not know keep their name and type.
    """
    known = {field.name: field.dataType for field in schema.fields}
    columns = []
    for field in df.schema.fields:
        wanted, value = known.get(field.name), F.col(field.name)
        if wanted is None or isinstance(wanted, T.DateType):
            columns.append(value)
            continue
        if isinstance(wanted, T.IntegerType) and isinstance(field.dataType, T.StringType):
            value = value.try_cast("double")
        value = value.try_cast(wanted)
        if isinstance(wanted, T.DoubleType):
            value = F.nanvl(value, F.lit(None).cast("double"))
        columns.append(value.alias(field.name))
    return df.select(columns)


def read_panel(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    strict_dates: bool = False,
    keep_file_order: bool = False,
    **options: str,
) -> DataFrame:
    """Scan the panel. CSV headers are matched by name, in any order.

    ``keep_file_order`` adds a sortable ``_row_order`` column (file, offset of
    the split, line within it) for :func:`upsert_keep_last`.
    """
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    if keep_file_order:
        df = df.withColumn(
            ROW_ORDER,
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ),
        )
    return cast_columns(parse_dates(normalize_columns(df), strict=strict_dates))


# -- batches ----------------------------------------------------------------


def union_batches(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Append a batch; a column only one side has is null on the other."""
    return existing.unionByName(batch, allowMissingColumns=True)


def keep_last(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    """One row per key, the last by ``order``.

    Spark turns ``row_number() = 1`` into a group limit before the shuffle, so
    however many copies a key has, each map task sends at most one of them.
    """
    window = Window.partitionBy(*keys).orderBy(*[column.desc_nulls_last() for column in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def upsert_keep_last(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str] = PANEL_KEY
) -> DataFrame:
    """The panel after a batch: the later batch wins, then the later row in it.

    Rows of one batch are ordered by ``_row_order`` where the reader provides
    it. Otherwise the largest values win, which is at least repeatable.
    """
    both = union_batches(
        existing.withColumn("_batch", F.lit(0)), batch.withColumn("_batch", F.lit(1))
    )
    order = [F.col("_batch")]
    if "ingest_id" in both.columns:
        order.append(F.col("ingest_id"))
    if ROW_ORDER in both.columns:
        order.append(F.col(ROW_ORDER))
    order += [F.col(c) for c in both.columns if c not in {*keys, "_batch", ROW_ORDER}]
    return keep_last(both, order, keys).drop("_batch", ROW_ORDER)


def upsert_unique(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str] = PANEL_KEY
) -> DataFrame:
    """:func:`upsert_keep_last` for a panel that already has one row per key.

    Only the batch is ranked. The panel loses the batch's keys in an anti join,
    whose small side Catalyst broadcasts, so the panel itself is not shuffled.
    """
    last = upsert_keep_last(batch.limit(0), batch, keys)
    kept = existing.join(last.select(*keys), list(keys), "left_anti")
    return union_batches(kept.drop(ROW_ORDER), last)


def ingest_report(batch: DataFrame) -> DataFrame:
    """Rows, stores and date range of a batch, as one row.

    The stores themselves are a DataFrame (:func:`list_stores`), as their number
    has no bound.
    """
    return batch.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("store_id").alias("stores"),
        F.min(DATE).alias("start"),
        F.max(DATE).alias("end"),
    )


def list_stores(df: DataFrame) -> DataFrame:
    return df.select("store_id").distinct()


def list_products(df: DataFrame, store_id: str | None = None) -> DataFrame:
    """Products of one store, or the (store, product) pairs of all."""
    if store_id is not None:
        df = df.filter(F.col("store_id") == store_id)
    return df.select("store_id", "product_id").distinct()


def ingest_batch(batch: DataFrame, path: str, ingest_id: str) -> None:
    """Land a validated batch as its own partition, stamped with the load time.

    Columns get their panel types, so that every upload lands alike, and the
    order of the file's rows stays for :func:`upsert_keep_last`. Running it again
    replaces that partition only.
    """
    stamped = (
        cast_columns(parse_dates(validate_columns(normalize_columns(batch))))
        .withColumn("uploaded_at", F.current_timestamp())
        .withColumn("ingest_id", F.lit(ingest_id))
    )
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_id")
        .parquet(path)
    )


# -- sinks ------------------------------------------------------------------


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel as parquet, one folder per year, clustered by series.

    Range partitioning cuts a long series into several files instead of sending
    it to one task.
    """
    (
        df.withColumn("year", F.year(DATE))
        .repartitionByRange("year", *SERIES, DATE)
        .sortWithinPartitions("year", *SERIES, DATE)
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def save_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Panel as a table bucketed by series, one sorted file per bucket.

    Features, policies, latest rows and everything else by series then read it
    without any exchange. Choose ``buckets`` for files of some hundred MB: a
    series is bounded by the calendar, so buckets are even. ``path`` puts the
    files outside the warehouse.
    """
    writer = (
        df.repartition(buckets, *SERIES)
        .sortWithinPartitions(*SERIES, DATE)
        .write.mode("overwrite")
        .bucketBy(buckets, *SERIES)
        .sortBy(*SERIES, DATE)
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def touched_years(batch: DataFrame) -> list[int | None]:
    """The years a batch has rows in, None for rows without a date: at most one entry per calendar year."""
    return [row[0] for row in batch.select(F.year(DATE)).distinct().collect()]


def read_years(spark: SparkSession, path: str, years: Sequence[int | None]) -> DataFrame:
    """The stored panel's rows of some years; the folders of others are not listed in the scan."""
    known = F.col("year").isin([year for year in years if year is not None])
    wanted = known | F.col("year").isNull() if None in years else known
    return _read_stored(spark, path).filter(wanted)


def _read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored panel; its year is a number also where no row has a date."""
    fields = [f for f in spark.read.parquet(path).schema if f.name != "year"]
    return spark.read.schema(T.StructType([*fields, T.StructField("year", T.IntegerType())])).parquet(path)


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str] = PANEL_KEY) -> list[int | None]:
    """Upsert a batch into the panel stored at ``path``, writing only the years it has rows in.

    A key holds its date, so a row can only replace one of its own year. The
    batch and then the merged years are staged in the shared folder; only when they are
    complete do they replace the years' folders, in one committed write. A
    run that fails before leaves the panel as it was, and running it again gives the
    same panel. Gives the touched years. The panel is created if there is none.
    """
    spark = batch.sparkSession
    staged = f"{ensure_checkpoint_dir(spark)}/panel-merge-{uuid.uuid4().hex}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folder(name: str):
        return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    batch.write.parquet(f"{staged}/batch")
    batch = spark.read.schema(batch.schema).parquet(f"{staged}/batch")
    years = touched_years(batch)
    if years:
        if files.exists(folder(path)):
            batch = upsert_keep_last(read_years(spark, path, years).drop("year"), batch, keys)
        else:
            batch = upsert_keep_last(batch.limit(0).drop(ROW_ORDER), batch, keys)
        write_panel(batch, f"{staged}/years")
        (
            _read_stored(spark, f"{staged}/years")
            .sortWithinPartitions("year", *SERIES, DATE)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("year")
            .parquet(path)
        )
    folder(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder(staged), True)
    return years


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_reorders(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    _write(df.select(*REORDER_COLUMNS), path, fmt, mode)


def write_eval_detail(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    _write(df.select(*EVALUATION_COLUMNS), path, fmt, mode)

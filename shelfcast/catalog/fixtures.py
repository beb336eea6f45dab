"""The sales panel, its variants and the relational tables, from the given tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import features_with_baseline
from ..operators.models import time_split
from ..operators.history import latest_row
from ..schema import TARGET

TARGET_DATE = "2001-12-03"

# Sales rows that one task turns into panel rows and their features: some 200 MB of hash tables
# and sort buffers.
TASK_ROWS = 300_000


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
        .select("s_suppkey", "s_name", "r_name")
    )


@lru_cache(maxsize=256)
def panel_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the rows of the panel, by the number of sales rows (which the file's footer has)."""
    rows = table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def retail_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date, store and product, laid by series.

    The sales are dealt by series to as many tasks as their number asks for, before they are
    summed: adaptive execution goes by compressed bytes, of which these rows have very few, and
    would leave millions of groups to a task. Windows along series find the layout they need.

    A sale's store is looked up table by table, each of a size that Catalyst knows. Of a join of
    the three it guesses the product of their sizes, and would sort all sales to meet it.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        F.col("l_shipdate").cast("date").alias("date"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    sold = (
        line.join(part, line["l_partkey"] == part["p_partkey"])
        .join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
        .join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
        .withColumn("store_id", F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")))
        .repartition(panel_tasks(spark, sf_dir), "store_id", "p_type")
        .groupBy("date", "store_id", "l_suppkey", "p_type", "region")
        .agg(
            (F.sum(F.col("l_linenumber") * 13 + F.col("l_partkey")) % 151).alias("stock"),
            F.greatest(F.sum("l_quantity") - 20, F.lit(0)).alias("units"),
            F.max("p_retailprice").alias("price"),
            F.max("l_discount").alias("rate"),
            F.max("p_size").alias("size"),
        )
    )
    month = F.month("date")
    return sold.select(
        "date",
        "store_id",
        F.col("p_type").alias("product_id"),
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "Core")
        .when(F.col("p_type") == "PROMO", "Promo")
        .otherwise("Sized")
        .alias("category"),
        "region",
        F.col("stock").cast("int").alias("inventory_level"),
        F.col("units").cast("int").alias("units_sold"),
        "price",
        (F.col("rate") * 100).alias("discount"),
        F.element_at(
            F.array(*[F.lit(name) for name in ("Sunny", "Rainy", "Cloudy", "Snowy")]),
            F.dayofmonth("date") % 4 + 1,
        ).alias("weather_condition"),
        F.when(F.col("rate") >= 0.08, 1).otherwise(0).alias("holiday_promotion"),
        (F.col("price") + F.col("size") - 25).alias("competitor_pricing"),
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
        .alias("seasonality"),
    )


def panel_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with features, ``actual`` and the baseline's ``predicted``."""
    featured = features_with_baseline(retail_panel(spark, sf_dir))
    return featured.withColumn("actual", F.col(TARGET))


def panel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_split(panel_pred(spark, sf_dir), panel=retail_panel(spark, sf_dir))


def panel_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel under the headers of an upload file."""
    headers = {
        "date": "Date",
        "store_id": "Store ID",
        "product_id": " Product ID",
        "category": "Category",
        "region": "Region",
        "inventory_level": "Inventory Level",
        "units_sold": "Units Sold ",
        "price": "Price",
        "discount": "Discount",
        "weather_condition": "Weather Condition",
        "holiday_promotion": " Holiday/Promotion ",
        "competitor_pricing": "Competitor Pricing",
        "seasonality": "Seasonality",
    }
    panel = retail_panel(spark, sf_dir)
    return panel.toDF(*[headers[name] for name in panel.columns])


def panel_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with bad values on some days and the date as text."""
    day = F.dayofmonth("date")
    panel = retail_panel(spark, sf_dir)
    return panel.withColumns(
        {
            "units_sold": F.when(day == 13, -1).otherwise(F.col("units_sold")),
            "price": F.when(day == 14, 0.0).otherwise(F.col("price")),
            "weather_condition": F.when(day != 15, F.col("weather_condition")),
            "date": F.when(day == 16, "bad").otherwise(F.date_format("date", "yyyy-MM-dd")),
        }
    )


def batch_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but July."""
    return retail_panel(spark, sf_dir).filter(F.month("date") != 7)


def batch_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """June again with other sales, and July; without the weather column."""
    panel = retail_panel(spark, sf_dir).filter(F.month("date").isin(6, 7))
    return panel.withColumn("units_sold", F.col("units_sold") + 1).drop("weather_condition")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of every series, asked about on one target date."""
    latest = latest_row(retail_panel(spark, sf_dir))
    return latest.withColumn("date", F.lit(TARGET_DATE).cast("date"))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("ts").cast("date").alias("date"), "user_id", "event_type").agg(
        F.count(F.lit(1)).cast("int").alias("units_sold")
    )


# -- relational tables ------------------------------------------------------


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_regions(spark, sf_dir).select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("region"),
    )


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.sum("l_quantity").alias("stock"), F.max("l_shipdate").alias("updated_at"))
    )
    return stock.select(
        (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("id"),
        F.col("l_suppkey").cast("int").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("stock").cast("int").alias("stock"),
        F.col("updated_at").cast("date").alias("updated_at"),
    )


def sales(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Sales rows; ``shift`` moves product keys past the last product."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").cast("int").alias("store_id"),
        (F.col("l_partkey") + shift).alias("product_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("int").alias("units_sold"),
        F.col("l_discount").alias("discount"),
        (F.col("l_discount") >= 0.08).alias("holiday"),
    )


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weekly sales of each (store, product) pair that has an inventory row."""
    return (
        sales(spark, sf_dir)
        .groupBy("store_id", "product_id", F.trunc("date", "week").alias("week_start"))
        .agg(F.avg("units_sold").alias("demand"))
    )


def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose stock is below their mean sale times three, as reorders."""
    sold = sales(spark, sf_dir).groupBy("store_id", "product_id").agg(
        F.avg("units_sold").alias("demand")
    )
    stock = inventory(spark, sf_dir)
    point = F.col("demand") * 3.0
    return (
        stock.join(sold, ["store_id", "product_id"])
        .filter(F.col("stock") < point)
        .select(
            "id",
            "store_id",
            "product_id",
            "demand",
            point.alias("reorder_point"),
            F.rint(point - F.col("stock")).cast("int").alias("order_qty"),
            F.when(F.col("stock") < F.col("demand"), "CRITICAL").otherwise("LOW").alias("risk_level"),
            F.col("updated_at").alias("created_at"),
        )
    )

"""Column names and types of the sales panel and the relational entities."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES = ("store_id", "product_id")
DATE = "date"
TARGET = "units_sold_7d"
LABEL = "log_units_sold_7d"

PANEL = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("inventory_level", T.IntegerType()),
        T.StructField("units_sold", T.IntegerType()),
        T.StructField("units_ordered", T.IntegerType()),
        T.StructField("demand_forecast", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("discount", T.DoubleType()),
        T.StructField("weather_condition", T.StringType()),
        T.StructField("holiday_promotion", T.IntegerType()),
        T.StructField("competitor_pricing", T.DoubleType()),
        T.StructField("seasonality", T.StringType()),
    ]
)

# What an upload must contain.
REQUIRED_COLUMNS = (
    "date",
    "store_id",
    "product_id",
    "category",
    "region",
    "inventory_level",
    "units_sold",
    "price",
)

# Text columns that get integer codes.
CATEGORICALS = (
    "store_id",
    "product_id",
    "category",
    "region",
    "weather_condition",
    "seasonality",
)

LAGS = (7, 14, 30, 60)
ROLLING_MEANS = (7, 30)
LAG_COLUMNS = tuple(f"lag_{n}" for n in LAGS) + tuple(f"rolling_mean_{n}" for n in ROLLING_MEANS)

# The model's inputs in training order. Weather has a code but is
# no input. Text columns enter through their ``*_idx`` code.
FEATURES = (
    "store_id",
    "product_id",
    "category",
    "region",
    "inventory_level",
    "price",
    "discount",
    "competitor_pricing",
    "holiday_promotion",
    "seasonality",
    "is_weekend",
    "week",
    "month",
    "lag_7",
    "lag_14",
    "lag_30",
    "lag_60",
    "rolling_mean_7",
    "rolling_mean_30",
)


def code_column(name: str) -> str:
    return f"{name}_idx"


def model_inputs() -> list[str]:
    """``FEATURES`` with each text column replaced by its code column."""
    return [code_column(name) if name in CATEGORICALS else name for name in FEATURES]


def _entity(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


ENTITIES = {
    "store": _entity(id=T.IntegerType(), name=T.StringType(), region=T.StringType()),
    "product": _entity(
        id=T.IntegerType(), name=T.StringType(), category=T.StringType(), price=T.DoubleType()
    ),
    "inventory": _entity(
        id=T.IntegerType(),
        store_id=T.IntegerType(),
        product_id=T.IntegerType(),
        stock=T.IntegerType(),
        updated_at=T.TimestampType(),
    ),
    "sales": _entity(
        id=T.IntegerType(),
        store_id=T.IntegerType(),
        product_id=T.IntegerType(),
        date=T.TimestampType(),
        units_sold=T.IntegerType(),
        discount=T.DoubleType(),
        holiday=T.BooleanType(),
    ),
    "forecast": _entity(
        id=T.IntegerType(),
        store_id=T.IntegerType(),
        product_id=T.IntegerType(),
        week_start=T.TimestampType(),
        demand=T.DoubleType(),
        created_at=T.TimestampType(),
    ),
    "reorder": _entity(
        id=T.IntegerType(),
        store_id=T.IntegerType(),
        product_id=T.IntegerType(),
        demand=T.DoubleType(),
        reorder_point=T.DoubleType(),
        order_qty=T.IntegerType(),
        risk_level=T.StringType(),
        created_at=T.TimestampType(),
    ),
    "uploaded_data": T.StructType(
        [T.StructField("id", T.IntegerType())]
        + PANEL.fields
        + [T.StructField("uploaded_at", T.TimestampType())]
    ),
    "trained_model": _entity(
        store_id=T.StringType(),
        model_path=T.StringType(),
        encoder_path=T.StringType(),
        accuracy=T.DoubleType(),
        trained_at=T.TimestampType(),
        record_count=T.LongType(),
        size_mb=T.DoubleType(),
    ),
}

# Primary keys, unique keys and foreign keys of the entities.
UNIQUE_KEYS = {
    "store": [("id",)],
    "product": [("id",)],
    "inventory": [("id",), ("store_id", "product_id")],
    "sales": [("id",)],
    "forecast": [("id",)],
    "reorder": [("id",)],
    "uploaded_data": [("id",)],
    "trained_model": [("store_id",)],
}
FOREIGN_KEYS = {
    name: {"store_id": ("store", "id"), "product_id": ("product", "id")}
    for name in ("inventory", "sales", "forecast", "reorder")
}

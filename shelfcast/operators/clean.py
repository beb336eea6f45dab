"""Row filters applied before features and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SERIES
from .joins import split_join

# Per-store training needs at least this many rows.
MIN_STORE_ROWS = 100


def clean_panel(df: DataFrame) -> DataFrame:
    """Rows with units_sold >= 0, price > 0 and no null or NaN in any column."""
    return df.filter((F.col("units_sold") >= 0) & (F.col("price") > 0)).dropna("any")


def series_filter(df: DataFrame, store_id: str, product_id: str) -> DataFrame:
    return df.filter((F.col("store_id") == store_id) & (F.col("product_id") == product_id))


class UnknownStore(ValueError):
    """A store that was asked for by name has no rows."""


def store_filter(df: DataFrame, stores: str | DataFrame) -> DataFrame:
    """Rows of one store, or of the stores in a DataFrame with ``store_id``.

    A single store must exist: a look at its first row decides.
    """
    if isinstance(stores, str):
        found = df.filter(F.col("store_id") == stores)
        if found.isEmpty():
            raise UnknownStore(f"no data for store {stores}")
        return found
    return split_join(df, stores.select("store_id").distinct(), ["store_id"], "left_semi")


def series_semi(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the series that occur in ``wanted``."""
    return split_join(df, wanted.select(*SERIES).distinct(), SERIES, "left_semi")


def min_rows_gate(
    df: DataFrame, min_rows: int = MIN_STORE_ROWS, keys: Sequence[str] = ("store_id",)
) -> DataFrame:
    """Drop all rows of stores that have fewer than ``min_rows``."""
    large = df.groupBy(*keys).count().filter(F.col("count") >= min_rows).select(*keys)
    return split_join(df, large, keys, "left_semi")


def drop_unscored(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Drop rows whose actual or predicted value is null or NaN."""
    return df.dropna(subset=[actual, predicted])

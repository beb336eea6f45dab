"""Relational tables joined with their store and product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_store_and_product(fact: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    """Each fact row with its store and product nested beside it.

    Foreign keys are never null, so inner joins lose nothing. There is no
    broadcast hint: Catalyst broadcasts a side whose size is below its
    threshold, and AQE splits a hot key's rows where both sides are large.
    """
    stores = store.select(
        F.col("id").alias("_store_key"),
        F.struct(*[F.col(name) for name in store.columns]).alias("store"),
    )
    products = product.select(
        F.col("id").alias("_product_key"),
        F.struct(*[F.col(name) for name in product.columns]).alias("product"),
    )
    return (
        fact.join(stores, fact["store_id"] == F.col("_store_key"))
        .join(products, fact["product_id"] == F.col("_product_key"))
        .drop("_store_key", "_product_key")
    )


def inventory_view(inventory: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    return with_store_and_product(inventory, store, product)


def inventory_by_id(
    inventory: DataFrame, store: DataFrame, product: DataFrame, row_id: int
) -> DataFrame:
    """One inventory row with its store and product; empty if there is none."""
    return with_store_and_product(inventory.filter(F.col("id") == row_id), store, product)


def sales_view(sales: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    return with_store_and_product(sales, store, product)


def forecast_view(forecast: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    return with_store_and_product(forecast, store, product)


def reorder_view(reorder: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    return with_store_and_product(reorder, store, product)


def recent_reorders(reorder: DataFrame) -> DataFrame:
    """Reorders, newest first."""
    return reorder.orderBy(F.col("created_at").desc(), "id")

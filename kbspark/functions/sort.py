"""Ranks inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_k(df: DataFrame, keys: list[str], order: list, k: int | None, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1; all rows if k is None."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return best_k(df, keys, order, 1, "__first").drop("__first")

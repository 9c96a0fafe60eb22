"""Ranking inside windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, partition: list[str], order: list[Column], rank: str = "row_num") -> DataFrame:
    """First k rows of each partition. Spark cuts each partition to k rows before the shuffle (WindowGroupLimit). End the order with a unique key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= k)

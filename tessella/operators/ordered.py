"""Operators over rows in an order: forward fill, islands, last-wins, newest-n. Every window has a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], order: list):
    return Window.partitionBy(*by).orderBy(*order)


def forward_fill(rows: DataFrame, by: list[str], order: list, value: Column, into: str) -> DataFrame:
    """The last value that is not null up to each row; null before the first."""
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def regions(rows: DataFrame, by: list[str], order: str, item: Column, breaker: Column) -> DataFrame:
    """(by, first_row, last_row, n_items): runs of items between breakers; other rows neither end a run nor extend it."""
    numbered = rows.withColumn("island", F.sum(breaker.cast("long")).over(_over(by, [order]).rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.where(item).groupBy(*by, "island").agg(F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count("*").alias("n_items"))
    return found.drop("island")


def last_wins(rows: DataFrame, key: Column, order: str, keep: list[str]) -> DataFrame:
    """One row a key with the values of its last row and the place of its first; rows with a blank key all stay.

    A partial maximum, so a key that a third of all rows share is merged before the shuffle.
    """
    keyed = rows.select(F.coalesce(key, F.lit("")).alias("key"), order, *keep)
    blank = keyed.where("key = ''").select(F.col(order).alias("place"), *keep)
    best = keyed.where("key <> ''").groupBy("key").agg(F.min(order).alias("place"), F.max(F.struct(order, *keep)).alias("row"))
    return best.select("place", *(F.col(f"row.{c}").alias(c) for c in keep)).unionByName(blank)


def best_wins(rows: DataFrame, key: Column, quality: Column, order: str, keep: list[str]) -> DataFrame:
    """One row a key: the highest quality, the earliest of equal ones."""
    found = rows.groupBy(key.alias("key")).agg(F.max(F.struct(quality.alias("quality"), (-F.col(order)).alias("early"), *keep)).alias("row"))
    return found.select("key", "row.quality", *(F.col(f"row.{c}").alias(c) for c in keep))


def newest(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in the order."""
    return rows.withColumn("rank", F.row_number().over(_over(by, order))).where(F.col("rank") <= n)

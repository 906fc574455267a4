"""Operators on the product catalogue: search, supplier price updates, merge, bulk changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.inference import junk
from tessella.functions.money import change_percent, half_up


def search(catalog: DataFrame, query: str, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Products with the query in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(query.lower()), F.lit(False))
    return catalog.where(hit)


def bulk_percent(catalog: DataFrame, supplier: str, percent: float, cost: str = "cost") -> DataFrame:
    """Costs of one supplier moved by a percentage and rounded; -100 or less is refused."""
    if percent <= -100:
        raise ValueError("a change must be above -100 percent")
    moved = half_up(F.col(cost) * (1 + percent / 100)).cast("double")
    return catalog.withColumn(cost, F.when(F.col("supplier") == supplier, moved).otherwise(F.col(cost)))


def price_update(catalog: DataFrame, feed: DataFrame) -> DataFrame:
    """Feed rows (sku, price) as updated, unchanged or new against the catalogue (sku, cost); rows without a code are dropped.

    Codes are equal up to case and outer blanks; of equal ones in the catalogue the last (`id`) counts.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    known = catalog.groupBy(key("sku").alias("key")).agg(F.max(F.struct("id", "cost")).alias("p")).select("key", "p.id", F.col("p.cost").alias("old"))
    asked = feed.withColumn("key", key("sku")).where("key <> ''")
    status = F.when(F.col("id").isNull(), "new").when(half_up(F.col("old")) != half_up(F.col("price")), "updated").otherwise("unchanged")
    return asked.join(known, "key", "left").select("sku", "id", "old", "price", status.alias("status"), change_percent(F.col("old"), F.col("price")).alias("percent"))


def merge(catalog: DataFrame, incoming: DataFrame, key: Column, kept: tuple[str, ...] = ("name",), filled: tuple[str, ...] = ("cost", "supplier")) -> DataFrame:
    """The catalogue after an import: `kept` columns stay as they were, `filled` ones take new values that are not blank or 0; other rows are added.

    Of incoming rows with equal keys each later one (`id`) overlays the earlier ones. A blank or null key is equal to none:
    each incoming row with one is added as it is, and catalogue rows with one are kept.
    """
    blank = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & ~F.col(c).cast("string").isin("0", "0.0"), F.col(c))
    columns = (*kept, *filled)
    coded = F.coalesce(F.col("key"), F.lit("")) != ""
    old, given = catalog.withColumn("key", key), incoming.select(key.alias("key"), "id", *columns)
    new = given.where(coded).groupBy("key").agg(
        F.max_by("id", "id").alias("new_id"), *(F.max_by(F.col(c), F.when(blank(c).isNotNull(), F.col("id"))).alias(f"new_{c}") for c in columns)
    )
    both = old.where(coded).join(new, "key", "full_outer")
    known = F.col("id").isNotNull()
    merged = both.select(
        "key", F.coalesce("id", "new_id").alias("id"),
        *(F.when(known, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in kept), *(F.coalesce(f"new_{c}", c).alias(c) for c in filled),
        F.when(~known, "added").when(F.col("new_id").isNotNull(), "updated").otherwise("kept").alias("action"),
    )
    uncoded = lambda rows, action: rows.where(~coded).select("key", "id", *columns, F.lit(action).alias("action"))
    return merged.unionByName(uncoded(old, "kept")).unionByName(uncoded(given, "added"))


def without_junk(catalog: DataFrame) -> DataFrame:
    """Without products (name, cost, sku) that are list items, clauses, terms or long texts."""
    return catalog.where(~junk(F.col("name"), F.col("cost"), F.col("sku")))

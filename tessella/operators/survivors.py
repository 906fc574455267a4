"""Which of several rows of one thing survives, and which of their values.

Both operators are aggregates that Spark merges before it shuffles, so a key that a third of all
rows share is reduced where its rows are read. Where values must be listed in order, only as many
rows as can still show in the result are kept, by a limit that Spark also applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import web_key
from tessella.functions.web import page_key

#: Characters of joined specifications, and issues, that a merged row keeps.
SPEC_CHARS, ISSUES = 1_000, 6
#: Rows whose specifications can show: each takes a character and three of separator at least.
SPEC_ROWS = SPEC_CHARS // 4 + 1


def item_key(name: Column, sku: Column, url: Column) -> Column:
    """What an item is told apart by: its name's key, else its code's, else its address; '' without any."""
    key = lambda kind, x: F.when(x != "", F.concat(F.lit(f"{kind}:"), x))
    return F.coalesce(key("name", web_key(name)), key("sku", web_key(sku)), key("url", page_key(url)), F.lit(""))


def item_quality(price: Column, image: Column, sku: Column, description: Column, confidence: Column) -> Column:
    points = lambda x, n: F.when(x, n).otherwise(0)
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    return points(price > 0, 2) + points(filled(image), 1) + points(filled(sku), 1) + points(filled(description), 1) + F.coalesce(confidence, F.lit(0.0))


def best_items(items: DataFrame, by: str = "page_id", order: str = "place") -> DataFrame:
    """One item for each key of a page: the best, the earliest of equal ones, at the place of the first.

    An item is worth 2 for a price, 1 each for an image, a code and a description, and its confidence. Items without a key are left out.
    """
    keyed = items.withColumns({"__key": item_key(F.col("name"), F.col("sku"), F.col("url")), "__worth": item_quality(F.col("price"), F.col("image"), F.col("sku"), F.col("description"), F.col("confidence")).cast("decimal(9,4)")})
    rest = [c for c in items.columns if c not in (by, order)]
    whole = F.struct(order, *rest)
    # the earliest of the best: of equal worth the lowest place wins
    worth = keyed.where("__key <> ''").groupBy(by, "__key", "__worth").agg(F.min(order).alias("__first"), F.min(whole).alias("__row"))
    best = worth.groupBy(by, "__key").agg(F.min("__first").alias(order), F.max_by("__row", "__worth").alias("__row"))
    return best.select(by, *(F.col(f"__row.{c}").alias(c) if c != order else F.col(order) for c in items.columns if c != by)).select(items.columns)


def merged_rows(rows: DataFrame, key: Column, order: str, amounts: list[str], lasting: list[str], keep: list[str]) -> DataFrame:
    """One row a key: the overlay of its rows in their order, at the place of the first.

    `amounts` have the last value that isn't zero, `lasting` (such as an image) the first that isn't blank, `keep` the
    last row's value; `specs` are joined by " | ", at most 1,000 characters; of `issues`, an array, the first six stay.
    Rows with a blank key are left out; a key's only row keeps its specs and issues whole. Rows of equal order are taken by their values.
    """
    values = [*keep, *amounts, *lasting, "specs", "issues"]
    keyed = rows.select(key.alias("key"), F.struct(order, *values).alias("at"), *values).where("key <> ''")
    last = lambda c, where: F.max(F.when(where, F.struct("at", c)))[c]
    fields = [F.max(F.struct("at", c))[c].alias(c) for c in keep]
    fields += [F.coalesce(last(c, F.coalesce(F.col(c), F.lit(0)) != 0), F.lit(0)).alias(c) for c in amounts]
    fields += [F.coalesce(F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("at", c)))[c], F.lit("")).alias(c) for c in lasting]
    one = keyed.groupBy("key").agg(F.count("*").alias("n_rows"), F.min(f"at.{order}").alias("place"), *fields)

    def first(condition: Column, n: int, c: str) -> DataFrame:
        ranked = keyed.where(condition).select("key", "at", c).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("at")))
        listed = ranked.where(F.col("k") <= n).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", c))).alias("x"))
        return listed.select("key", F.transform("x", lambda v: v[c]).alias(c))

    specs, issues = first(F.coalesce("specs", F.lit("")) != "", SPEC_ROWS, "specs"), first(F.size("issues") > 0, ISSUES, "issues")
    joined = F.array_join("specs", " | ")
    listed = F.flatten("issues")
    out = one.join(specs, "key", "left").join(issues, "key", "left")
    return out.select(
        "key", "place", "n_rows", *keep, *amounts, *lasting,
        F.coalesce(F.when(F.col("n_rows") > 1, F.substring(joined, 1, SPEC_CHARS)).otherwise(joined), F.lit("")).alias("specs"),
        F.coalesce(F.when(F.col("n_rows") > 1, F.slice(listed, 1, ISSUES)).otherwise(listed), F.array().cast(rows.schema["issues"].dataType)).alias("issues"),
    )

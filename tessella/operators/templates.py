"""Saved column maps of sheet layouts: kept by key, put over found maps, suggested for like headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import fnv1a, learning_key
from tessella.operators.imports import profile_key

# The prefix of keys, and the least and the kept number of suggestions.
PREFIX, LEAST, MOST = "sq_catalog_template_", 0.15, 8
KEPT, SURE, SUPPLIER_POINTS = 80, 0.8, 0.35


def labels(headers: Column) -> Column:
    """The headers as keys, empty ones left out."""
    return F.filter(F.transform(F.coalesce(headers, F.array().cast("array<string>")), lambda h: learning_key(F.coalesce(h, F.lit("")))), lambda h: h != "")


def signature(headers: Column, file: Column) -> Column:
    """Supplier's key, number of headers and header keys."""
    return F.concat_ws("::", profile_key(file, F.lit("")), F.greatest(F.size(F.coalesce(headers, F.array().cast("array<string>"))), F.lit(0)).cast("string"), F.array_join(labels(headers), "|"))


def template_key(headers: Column, file: Column) -> Column:
    return F.concat(F.lit(PREFIX), fnv1a(signature(headers, file)))


def saved(old: DataFrame, new: DataFrame, by: str = "owner", most: int = KEPT) -> DataFrame:
    """The templates of each owner after saving: the last of a key, the `most` latest; of equal times those of greater keys.

    Both: owner, key, saved_at and columns alike. A new template takes the place of an old one of its key whatever its time.
    """
    rest = [c for c in old.columns if c not in (by, "key")]
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    last = both.groupBy(by, "key").agg(F.max_by(F.struct(*rest), F.struct("fresh", "saved_at")).alias("t")).select(by, "key", "t.*")
    # a rank under a bound: no task sorts all templates of an owner
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("saved_at"), F.desc("key")))
    return last.withColumn("place", place).where(F.col("place") <= most).drop("place")


def deleted(templates: DataFrame, keys: DataFrame, by: str = "owner") -> DataFrame:
    """Templates without those of these keys; keys of other kinds delete nothing. keys: owner, key."""
    return templates.join(keys.where(F.startswith("key", F.lit(PREFIX))).select(by, "key"), [by, "key"], "left_anti")


def with_saved(maps: DataFrame, templates: DataFrame, fields: list[str]) -> DataFrame:
    """Found maps with the saved columns of their template and sheet put over them, field by field, and `known`.

    maps: template, sheet, fields, confidence; templates: template, sheet, fields (null: not saved), one row a sheet. A sheet
    with a saved map has a confidence of 0.8 or more; a known template without that sheet changes nothing.
    """
    kept = templates.select("template", "sheet", F.struct(*fields).alias("saved"))
    found = maps.join(kept, ["template", "sheet"], "left").join(templates.select("template").distinct().withColumn("known", F.lit(True)), "template", "left")
    sure = F.when(F.col("saved").isNotNull(), F.greatest(F.col("confidence"), F.lit(SURE))).otherwise(F.col("confidence"))
    return found.withColumns({**{f: F.coalesce(F.col(f"saved.{f}"), F.col(f)) for f in fields}, "confidence": sure, "known": F.coalesce("known", F.lit(False))}).drop("saved")


def suggestions(sheets: DataFrame, templates: DataFrame, most: int = MOST) -> DataFrame:
    """(sheet, key, score, place): an owner's templates for a sheet: 1 for an equal signature, 0.35 for the supplier's key within the name, and the share of common header words.

    sheets: owner, sheet, headers, file; templates: owner, key, name, signature, saved_at, of which an owner has a bounded
    number (`saved`), so a sheet meets that many at most. The latest comes first of equal scores, then the lesser key.
    """
    words = lambda x: F.array_distinct(F.filter(F.split(learning_key(x), " "), lambda w: w != ""))
    asked = sheets.select("owner", "sheet", signature(F.col("headers"), F.col("file")).alias("asked"), profile_key(F.col("file"), F.lit("")).alias("supplier"), words(F.array_join(labels(F.col("headers")), " ")).alias("a"))
    parts = F.split(F.coalesce("signature", F.lit("")), "::")
    kept = templates.select("owner", "key", "signature", learning_key(F.coalesce("name", F.lit(""))).alias("name"), "saved_at", words(F.array_join(F.slice(parts, 3, 1_000), " ")).alias("b"))
    common, longer = F.size(F.array_intersect("a", "b")), F.greatest(F.size("a"), F.size("b"))
    alike = F.when((F.size("a") > 0) & (F.size("b") > 0), common / longer).otherwise(0.0)
    score = F.when(F.col("asked") == F.col("signature"), 1.0).otherwise(0.0) + F.when((F.col("supplier") != "") & F.contains("name", "supplier"), SUPPLIER_POINTS).otherwise(0.0) + alike
    found = asked.join(kept, "owner").withColumn("score", F.floor(score * 100 + 0.5) / 100)
    place = F.row_number().over(Window.partitionBy("owner", "sheet").orderBy(F.desc("score"), F.desc("saved_at"), "key"))
    return found.where(F.col("score") > LEAST).withColumn("place", place).where(F.col("place") <= most).select("owner", "sheet", "key", "score", "place")

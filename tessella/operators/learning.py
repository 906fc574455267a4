"""What users' corrections teach: rules by code and by raw text, profiles of suppliers, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import learning_key, sku_key

FIELDS = ("name", "sku", "category", "supplier", "unit", "cost")
# Categories that say nothing.
PLACEHOLDERS = ["", "chung", "san pham", "bang bao gia", "bao gia"]


def compact(x: Column) -> Column:
    return F.replace(learning_key(x), F.lit(" "), F.lit(""))


def rules(accepted: DataFrame, order: str) -> DataFrame:
    """(kind, key, accepted, edited, fields...): rules by code and by raw text of six characters or more, from accepted products in an order.

    Each acceptance overlays the fields before it, and counts; one by hand counts as an edit too.
    """
    keys = F.array(F.struct(F.lit("sku").alias("kind"), sku_key(F.trim("sku")).alias("key")), F.struct(F.lit("raw").alias("kind"), compact(F.coalesce("raw", "name")).alias("key")))
    named = accepted.where((F.trim(F.coalesce("name", F.lit(""))) != "") | (F.trim(F.coalesce("sku", F.lit(""))) != ""))
    rows = named.withColumn("k", F.explode(keys)).where("(k.kind = 'sku' and k.key <> '') or length(k.key) >= 6")
    return rows.groupBy("k.kind", "k.key").agg(F.count("*").alias("accepted"), F.count_if("edited").alias("edited"), *(F.max_by(f, order).alias(f) for f in FIELDS))


def supplier_profiles(accepted: DataFrame) -> DataFrame:
    """(profile, field, value, n): how often each supplier's accepted products have each category, supplier and unit."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in ("category", "supplier", "unit")))
    key = F.substring(learning_key(F.col("supplier")), 1, 80)
    rows = accepted.select(key.alias("profile"), F.explode(pairs).alias("p")).where("profile <> '' and p.value <> ''")
    return rows.groupBy("profile", "p.field", "p.value").agg(F.count("*").alias("n"))


def stats(learned: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: numbers of rules by kind and of profiles."""
    counts = learned.agg(F.count_if(F.col("kind") == "sku").alias("sku_rules"), F.count_if(F.col("kind") == "raw").alias("raw_rules"))
    return counts.crossJoin(profiles.agg(F.countDistinct("profile").alias("profiles")))  # one row with one row


def _changes(learned: Column) -> list[tuple[str, Column]]:
    """For each field, where a learned value takes the place of the present one."""
    has = lambda f: F.coalesce(learned[f].cast("string"), F.lit("")) != ""
    blank = lambda f: F.coalesce(F.col(f), F.lit("")) == ""
    now, then = compact(F.col("name")), compact(learned["name"])
    return [
        ("name", has("name") & (blank("name") | ((now != then) & (F.length(now) <= 18) & (F.length(then) > F.length(now) + 6)))), ("sku", blank("sku") & has("sku")),
        ("category", learning_key(F.col("category")).isin(PLACEHOLDERS) & has("category")), ("supplier", blank("supplier") & has("supplier")),
        ("unit", (blank("unit") | (learning_key(F.col("unit")) == "cai")) & has("unit")), ("cost", (F.coalesce("cost", F.lit(0.0)) <= 0) & (learned["cost"] > 0)),
    ]


def apply(products: DataFrame, learned: DataFrame) -> DataFrame:
    """Products with learned fields, and `how`: by the code's rule, or by the raw text's if the first changes nothing."""
    fields = F.struct(*FIELDS)
    rule = lambda kind: learned.where(F.col("kind") == kind).select(F.col("key").alias(f"{kind}_key"), fields.alias(kind))
    found = products.join(rule("sku").withColumnsRenamed({"sku": "by_sku", "sku_key": "code_key"}), sku_key(F.trim("sku")) == F.col("code_key"), "left")
    found = found.join(rule("raw"), compact(F.coalesce("raw_text", "name")) == F.col("raw_key"), "left")
    any_of = lambda changes: F.coalesce(F.greatest(*(F.coalesce(c, F.lit(False)) for _, c in changes)), F.lit(False))
    by_code, by_raw = _changes(F.col("by_sku")), _changes(F.col("raw"))
    how = F.when(F.col("by_sku").isNotNull() & any_of(by_code), "sku").when(F.col("raw").isNotNull() & any_of(by_raw), "raw").otherwise("none")
    found = found.withColumn("how", how)
    out = [F.when((F.col("how") == "sku") & a, F.col("by_sku")[f]).when((F.col("how") == "raw") & b, F.col("raw")[f]).otherwise(F.col(f)).alias(f) for (f, a), (_, b) in zip(by_code, by_raw, strict=True)]
    return found.select("id", "how", *out)

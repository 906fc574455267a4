"""Validation issues, confidence and status of imported items, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.inference import DOMAIN_WORDS, speaks_of

#: Name words of total and note rows.
NOTE_WORDS = "tổng cộng|thành tiền|vat|thuế|chiết khấu|ghi chú"


def issues(name: Column, price: Column, sku: Column, subtotal: Column) -> Column:
    """Array of (code, level)."""
    name, sku, price = F.coalesce(name, F.lit("")), F.coalesce(sku, F.lit("")), F.coalesce(price, F.lit(0))
    issue = lambda condition, code, level: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level")))
    short, none, uncoded = F.length(F.trim(name)) < 2, price == 0, sku == ""
    return F.array_compact(
        F.array(
            issue(short, "missing_product_name", "error"), issue(~short & (F.length(name) > 200), "name_too_long", "warning"),
            issue(none, "missing_price", "error"), issue(~none & (price < 1000), "price_too_low", "error"), issue(price > 5_000_000_000, "price_too_high", "error"),
            issue(uncoded & ~subtotal, "missing_sku", "info"), issue(uncoded & F.trim(name).rlike("(?iu)^sản phẩm$"), "generic_product_name", "error"),
            issue(F.lower(name).rlike(NOTE_WORDS), "possible_note_or_total", "warning"), issue(subtotal, "generic_category_subtotal", "info"),
            issue(none & uncoded, "no_price_no_sku", "error"),
        )
    )


def scored(items: DataFrame, map_confidence: float = 0.5) -> DataFrame:
    """Items (name, price, sku, subtotal, match_score or null) with issues, confidence, status and final status."""
    found = items.withColumn("issues", issues(F.col("name"), F.col("price"), F.col("sku"), F.col("subtotal")))
    coded, priced = F.coalesce(F.col("sku"), F.lit("")) != "", F.coalesce(F.col("price"), F.lit(0)) != 0
    matched = F.col("match_score").isNotNull()
    count = lambda level: F.size(F.filter("issues", lambda i: level(i["level"])))
    serious, errors = count(lambda v: v != "info"), count(lambda v: v == "error")
    confidence = (
        F.lit(0.3) + F.lit(0.4) * map_confidence + F.when(F.col("price") >= 1000, 0.15).otherwise(0.0) + F.when(coded, 0.1).otherwise(0.0)
        + F.when(matched, F.col("match_score") * 0.15).otherwise(0.0) - serious * F.lit(0.08)
    )
    found = found.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
    nameless = F.exists("issues", lambda i: i["code"] == "missing_product_name")
    status = (
        F.when(F.col("subtotal"), "skipped").when(nameless | (~priced & ~coded), "rejected").when(matched & (F.col("confidence") >= 0.7), "matched")
        .when((F.col("confidence") < 0.55) | (errors > 0) | (serious >= 2), "review").otherwise("new")
    )
    found = found.withColumn("status", status)
    final = (
        F.when(F.col("status") == "rejected", "failed").when(F.col("status") == "skipped", "skipped").when(F.col("status") == "review", "need_review")
        .when((errors > 0) & (F.col("confidence") < 0.7), "failed").when(F.col("confidence") < 0.62, "need_review").otherwise("auto_approved")
    )
    return found.withColumn("final_status", final)


def summary(lines: DataFrame) -> DataFrame:
    """One row: counts by status, and the mean confidence of lines that are not skipped."""
    n = lambda s: F.count_if(F.col("final_status") == s).alias(s)
    mean = F.avg(F.when(F.col("final_status") != "skipped", F.col("confidence")))
    return lines.agg(
        F.count("*").alias("total"), n("auto_approved"), n("need_review"), n("failed"), n("skipped"), F.count_if(F.col("status") == "matched").alias("matched"),
        (F.floor(F.coalesce(mean, F.lit(0.0)) * 100 + 0.5) / 100).alias("confidence"),
    )


def detect_domain(items: DataFrame, group: str, order: str, text: Column, first: int = 50) -> DataFrame:
    """(group, domain, share): the domain most of a group's first items speak of, the earlier listed of equals; 'general' where none does."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    sample = items.select(group, order, text.alias("text")).withColumn("place", place).where(F.col("place") <= first)
    counts = sample.groupBy(group).agg(F.count("*").alias("n"), *(F.count_if(speaks_of(F.col("text"), d)).alias(d) for d in DOMAIN_WORDS))
    best = F.array_max(F.array(*(F.struct(F.col(d).alias("score"), F.lit(-k).alias("early"), F.lit(d).alias("domain")) for k, d in enumerate(DOMAIN_WORDS))))
    return counts.select(group, "n", best.alias("b")).select(
        group, F.when(F.col("b.score") > 0, F.col("b.domain")).otherwise("general").alias("domain"), (F.col("b.score") / F.col("n")).alias("share")
    )

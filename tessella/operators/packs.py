"""Solution packs: products for the components of a template and for vendors' options, and how well a scope is served by them.

Components and options are parameters, lists of a few dozen entries, so scores are column
expressions over the products: no product meets a component by a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.patterns import plain


class Component(NamedTuple):
    family: str
    role: str
    required: bool
    auto: bool
    words: list[str]


class Option(NamedTuple):
    family: str
    option: str
    vendor: str
    words: list[str]


def search_text(*columns: str) -> Column:
    return plain(F.concat_ws(" ", *columns))


def _points(text: Column, words: list[str], long: float, short: float) -> tuple[Column, Column]:
    """(score, hits) by words that occur; those of six characters or more count as long."""
    hits = [(F.contains(text, F.lit(w)), long if len(w) >= 6 else short) for w in words]
    add = lambda weight: sum((F.when(h, weight(s)).otherwise(0) for h, s in hits), F.lit(0))
    return add(lambda s: s).cast("double"), add(lambda s: 1).cast("int")


def component_candidates(products: DataFrame, components: list[Component], vendor: str = "", k: int = 5) -> DataFrame:
    """(family, role, product, score, price, place): up to k products a component. products: product, text, supplier, price.

    A vendor's name counts only beside a word of the component. Of equal scores the cheaper product comes first.
    """
    branded = F.lit(vendor != "") & (F.contains("supplier", F.lit(vendor)) | F.contains("text", F.lit(vendor)))
    rows = []
    for c in components:
        score, hits = _points(F.col("text"), c.words, 0.22, 0.14)
        rows.append(F.struct(F.lit(c.family).alias("family"), F.lit(c.role).alias("role"), F.least(F.lit(0.99), score + F.when(branded, 0.18).otherwise(0.0)).alias("score"), hits.alias("hits")))
    found = products.select("product", "price", F.inline(F.filter(F.array(*rows), lambda r: (r["hits"] >= 1) & (r["score"] >= 0.22))))
    place = F.row_number().over(Window.partitionBy("family", "role").orderBy(F.desc("score"), "price", "product"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("family", "role", "product", "score", "price", "place")


def template_coverage(components: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per family how many of its required components have a candidate, and what that makes it. components: family, role, required, auto."""
    matched = components.join(candidates.select("family", "role").distinct().withColumn("matched", F.lit(True)), ["family", "role"], "left").fillna(False, ["matched"])
    counts = matched.groupBy("family").agg(
        F.count("*").alias("components"), F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("matched")).alias("required_matched"), F.count_if(F.col("auto") & F.col("matched")).alias("auto_ready")
    )
    coverage = F.when(F.col("required") > 0, F.floor(F.col("required_matched") / F.col("required") * 100 + 0.5)).otherwise(100).cast("long")
    return counts.withColumn("coverage", coverage).withColumn("status", F.when(F.col("coverage") >= 100, "ready").when(F.col("coverage") >= 50, "partial").otherwise("weak"))


def component_choice(candidates: DataFrame) -> DataFrame:
    """(family, role, budget, standard, premium): the cheapest, the first and the dearest candidate; of equal prices the earlier one."""
    early = -F.col("place")
    return candidates.groupBy("family", "role").agg(
        F.min_by("product", F.struct("price", "place")).alias("budget"), F.min_by("product", "place").alias("standard"), F.max_by("product", F.struct(F.col("price"), early)).alias("premium")
    )


def option_products(products: DataFrame, options: list[Option], k: int = 12) -> DataFrame:
    """(family, option, product, score, cost, price, place): up to k products an option; a vendor's own name is no word of it."""
    rows = []
    for o in options:
        vendor = o.vendor.lower()
        score, hits = _points(F.col("text"), [w for w in o.words if w != vendor], 0.14, 0.08)
        branded = F.contains("supplier", F.lit(vendor)) | F.contains("text", F.lit(vendor))
        rows.append(F.struct(F.lit(o.family).alias("family"), F.lit(o.option).alias("option"), F.least(F.lit(0.98), score + F.when(branded, 0.18).otherwise(0.0)).alias("score"), hits.alias("hits")))
    found = products.select("product", "cost", "price", F.inline(F.filter(F.array(*rows), lambda r: (r["hits"] >= 1) & (r["score"] >= 0.18))))
    place = F.row_number().over(Window.partitionBy("family", "option").orderBy(F.desc("score"), "product"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("hits")


def line_fit(lines: DataFrame, options: list[Option]) -> DataFrame:
    """(family, option, fit, n_lines): how well the lines of a scope speak of an option. lines: family, text."""
    rows = [F.struct(F.lit(o.family).alias("of"), F.lit(o.option).alias("option"), F.least(F.lit(0.95), _points(F.col("text"), o.words, 0.16, 0.09)[0]).alias("fit")) for o in options]
    found = lines.select("family", F.inline(F.array(*rows))).where("family = of")
    return found.groupBy("family", "option").agg(F.avg("fit").alias("fit"), F.count("*").alias("n_lines"))


def suggestions(fits: DataFrame, chosen: DataFrame, confidence: float = 0.65, k: int = 3) -> DataFrame:
    """(family, option, score, confidence, products, cost, revenue, place): the k best options of each scope."""
    top = chosen.groupBy("family", "option").agg(
        F.count("*").alias("products"), F.sum(F.when(F.col("place") <= 4, F.col("cost")).otherwise(0.0)).alias("cost"), F.sum(F.when(F.col("place") <= 4, F.col("price")).otherwise(0.0)).alias("revenue")
    )
    both = fits.join(top, ["family", "option"], "left").fillna({"products": 0, "cost": 0.0, "revenue": 0.0})
    coverage = F.least(F.lit(1.0), F.col("products") / F.greatest(F.lit(2), F.least(F.lit(8), F.col("n_lines"))))
    score = F.least(F.lit(0.99), 0.34 * F.col("fit") + 0.34 * coverage + 0.2 * F.lit(confidence) + F.when(F.col("products") > 0, 0.12).otherwise(0.0))
    scored = both.withColumn("raw", score)
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc(F.floor(F.col("raw") * 100 + 0.5)), "option"))
    sure = F.when(F.col("raw") >= 0.72, "high").when(F.col("raw") >= 0.48, "medium").otherwise("low")
    return scored.withColumns({"place": place, "confidence": sure, "score": F.floor(F.col("raw") * 100 + 0.5).cast("long")}).where(F.col("place") <= k).select("family", "option", "score", "confidence", "products", "cost", "revenue", "place")

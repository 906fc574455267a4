"""Items out of the product rows of sheets: cost and list price by column, price tiers, codes from hidden cells, derived names.

Rows have an array of cells `text`, whose length the sheet format bounds; everything is
column expressions over a row and its sheet's column map, joined by sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import naming as N
from tessella.functions.cleaning import bad_category, infer_category
from tessella.functions.money import vnd
from tessella.functions.patterns import hits, joined, plain
from tessella.functions.products import best_code, code_candidates, safe_price
from tessella.functions.text import BOUNDARY, clean_text
from tessella.operators.rows import whole_row

# Words in the specifications of an item, its defaults, and code labels within a feature.
OLD_PRICE, CURRENT_PRICE, LEAST_PRICE, UNIT = "Giá niêm yết cũ", "Giá điều chỉnh", "Giá bán lẻ thấp nhất", "Cái"
CODE_LABEL = r"(?:^|[;|,])\s*(mã\s*khóa\s*sử\s*dụng|ma\s*khoa\s*su\s*dung|model|sku|mã\s*sp|ma\s*sp)\s*[:：]?\s*[^;|,]+"
NAMELESS = "^sản phẩm$"
LEAST_TIER, TIER_SLACK = 1_000, 1.05

MAP = ("name", "sku", "specs", "unit", "category", "supplier", "price", "list_price", "current_price", "least_price", "other_price")
LISTS = ("hidden_sku_cols", "feature_cols", "name_source_cols", "tier_cols")


def price_labels(maps: DataFrame, headers: DataFrame) -> DataFrame:
    """Column maps with `price_label`, the header of the current price; null without one. headers: (sheet, text), one row a sheet."""
    label = F.trim(F.get(F.col("header"), F.col("current_price")))
    return maps.join(headers.select("sheet", F.col("text").alias("header")), "sheet", "left").withColumn("price_label", F.nullif(label, F.lit(""))).drop("header")


def feature_text(x: Column) -> Column:
    """A feature without labelled codes, prices, long numbers and codes; its parts joined by slashes."""
    text = F.regexp_replace(clean_text(x), "(?iu)" + CODE_LABEL, " ")
    for number in (r"\d{1,3}(?:[.,]\d{3}){1,4}", r"\d{5,10}"):
        text = F.regexp_replace(text, BOUNDARY + number + BOUNDARY, " ")
    text = clean_text(text)
    without = F.aggregate(code_candidates(text), text, lambda t, code: F.regexp_replace(t, F.concat(F.lit(r"(?i)\Q"), code, F.lit(r"\E")), F.lit(" ")))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(without, r"\s*[,;|]\s*", "/"), "/{2,}", "/"), "^/+|/+$", ""))


def _texts(columns: Column) -> Column:
    """The cells of these columns, clean, that are not empty."""
    return F.filter(F.transform(columns, lambda c: clean_text(F.get(F.col("text"), c))), lambda t: t != "")


def _first(texts: Column) -> Column:
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def _priced(rows: DataFrame) -> DataFrame:
    """cost, listed, current, old, least and tier of each row.

    A current price is the list price, and the cost too unless a cost column or a tier says
    less. Without any cost the least price counts of the cells that hold no name, code or
    price of another kind.
    """
    zero = F.lit(0).cast("long")
    at = lambda f: safe_price(F.get(F.col("text"), F.col(f)))
    rows = rows.withColumns({"asked": at("price"), "old": at("list_price"), "current": at("current_price"), "least": at("least_price")})
    tiers = F.filter(F.transform("tier_cols", lambda c: safe_price(F.get(F.col("text"), c))), lambda p: (p >= LEAST_TIER) & ((F.col("current") == 0) | (p <= F.col("current") * TIER_SLACK)))
    others = F.array_compact(F.array("name", "sku", "list_price", "current_price", "least_price"))
    loose = F.filter(F.transform("text", lambda t, i: F.when(F.array_contains(F.concat(others, F.col("tier_cols")), i), zero).otherwise(safe_price(t))), lambda p: p > 0)
    rows = rows.withColumns({"tier": F.array_min(tiers), "loose": F.array_min(loose)})
    shared = [F.col("price").eqNullSafe(F.col(c)) for c in ("list_price", "current_price", "least_price")]
    explicit = (F.col("asked") > 0) & ~(shared[0] | shared[1] | shared[2])
    first = F.when((F.col("current") > 0) & ~explicit, F.coalesce("tier", "current")).when((F.col("current") == 0) & (F.col("asked") == 0), F.coalesce("tier", zero)).otherwise(F.col("asked"))
    listed = F.when(F.col("current") > 0, F.col("current")).when(F.col("old") > 0, F.col("old")).otherwise(at("other_price"))
    return rows.withColumn("cost", first).withColumn("cost", F.when(F.col("cost") == 0, F.coalesce("loose", zero)).otherwise(F.col("cost"))).withColumn("listed", listed)


def _specified(rows: DataFrame) -> DataFrame:
    """Specifications with old, current and least prices, and up to three texts of feature and name-source columns."""
    shown = lambda label, price: F.concat(label, F.lit(": "), vnd(F.col(price)), F.lit("đ"))
    changed = F.when((F.col("current") > 0) & (F.col("old") > 0) & (F.col("old") != F.col("current")), shown(F.lit(OLD_PRICE), "old"))
    current = F.when(F.col("current") > 0, shown(F.coalesce("price_label", F.lit(CURRENT_PRICE)), "current"))
    rows = rows.withColumn("specs_text", N.with_spec(F.col("specs_text"), changed)).withColumn("specs_text", N.with_spec(F.col("specs_text"), current))
    more = F.filter(_texts(F.array_distinct(F.concat("name_source_cols", "feature_cols"))), lambda t: (t != F.col("specs_text")) & (t != F.col("item")))
    rows = rows.withColumn("specs_text", F.array_join(F.filter(F.concat(F.array("specs_text"), F.slice(more, 1, 3)), lambda t: t != ""), " | "))
    least = shown(F.lit(LEAST_PRICE), "least")
    with_least = F.when(F.col("specs_text") == "", least).otherwise(F.concat("specs_text", F.lit(" · "), least))
    return rows.withColumn("specs_text", F.when(F.col("least") > 0, with_least).otherwise(F.col("specs_text")))


def _named(rows: DataFrame) -> DataFrame:
    """Names: of features or of type, brand and model where the sheet has no names or the name says nothing."""
    kind = lambda specs, code: N.type_of(F.col("sheet_name"), F.col("section"), specs, code, F.col("kind_of"))
    name, code, specs = F.col("item"), F.col("code"), F.col("specs_text")
    fitting = N.type_of(F.col("sheet_name"), F.col("section"), specs, code, F.lit(""))
    fallback = F.when(clean_text(F.col("section")) != "", clean_text(F.col("section"))).otherwise(fitting)
    rows = rows.withColumn("fallback", fallback).withColumn("kind_of", infer_category(
        F.col("category_text"), name, code, specs, joined(F.col("section"), F.col("sheet_name")), F.col("file_supplier"), F.col("raw"), F.when(bad_category(F.col("fallback")), "Chung").otherwise(F.col("fallback"))
    )).withColumn("brand", N.brand_of(F.col("sheet_name"), F.col("section"), F.col("file_supplier")))
    rows = rows.withColumns({
        "feature": feature_text(F.coalesce(F.get(_texts(F.col("feature_cols")), F.lit(0)), _first(_texts(F.col("name_source_cols"))))),
        "model": N.model_text(F.when(code != "", code).otherwise(best_code(joined(clean_text(name), specs)))),
    })
    branded = F.when(F.contains(plain(code), plain(F.col("brand"))), "").otherwise(F.col("brand"))
    short = F.when((F.length("feature") >= 4) & ~N.colour_only(F.col("feature")), N.short_feature(F.col("feature"))).otherwise("")
    parts = F.filter(F.array(kind(joined(specs, F.col("feature")), code), F.col("brand"), short), lambda t: t != "")
    rows = rows.withColumns({
        "by_feature": clean_text(F.when(F.length(code) >= 4, joined(kind(joined(specs, F.col("feature")), code), branded, code)).otherwise(F.array_join(parts, " - "))),
        "by_model": N.display_name(name, F.col("model"), kind(specs, F.when(F.col("model") != "", F.col("model")).otherwise(code)), F.col("brand")),
    })
    featured = ((name == "") | F.col("from_feature")) & (F.size(F.concat("feature_cols", "name_source_cols")) > 0) & (F.length("by_feature") >= 6)
    derived = (F.col("from_sku") | N.must_derive_name(name, code)) & (F.col("by_model") != "")
    rows = rows.withColumn("item", F.when(featured, F.col("by_feature")).when(derived, F.col("by_model")).otherwise(name))
    bare = (F.col("item") == "") & (specs != "") & (code == "")
    rows = rows.withColumn("item", F.when(bare, F.substring(specs, 1, 60)).otherwise(F.col("item")))
    return rows.withColumn("item", F.when(F.length("item").between(1, 5) & (code != ""), F.col("by_model")).otherwise(F.col("item")))


def sheet_items(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """One item a product row: (sheet, idx, name, sku, category, supplier, unit, cost, listed, least, price_mode, specs, current, old, used_tier, subtotal).

    rows: sheet, idx, text, sheet_name, section, file_supplier (nulls count as ''); maps: one row
    a sheet as `map_columns` gives it, with `price_label`. Rows without a map, and rows that get
    no name of two characters, or no code and only the word for product as name, give no item.
    """
    context = ("sheet_name", "section", "file_supplier")
    base = rows.select("sheet", "idx", F.coalesce("text", F.array().cast("array<string>")).alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in context))
    listed = maps.select("sheet", *MAP, *(F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in LISTS), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("from_feature", "from_sku")), "price_label")
    cell = lambda f: F.coalesce(F.trim(F.get(F.col("text"), F.col(f))), F.lit(""))
    found = base.join(listed, "sheet").withColumns({
        "item": cell("name"), "code": N.model_text(cell("sku")), "specs_text": cell("specs"), "category_text": cell("category"), "own_supplier": cell("supplier"), "own_unit": cell("unit"),
        "raw": whole_row(F.col("text")), "hidden": N.model_text(N.hidden_code(_texts(F.col("hidden_sku_cols")))),
    })
    found = _specified(_priced(found.withColumn("code", F.when(F.col("code") == "", F.col("hidden")).otherwise(F.col("code")))))
    spoken = N.model_text(best_code(joined(F.col("item"), F.col("specs_text"), F.col("raw"))))
    found = _named(found.withColumn("code", F.when(F.col("code") == "", spoken).otherwise(F.col("code"))))
    kept = (F.length("item") >= 2) & ~((F.col("code") == "") & hits(clean_text(F.col("item")), NAMELESS))
    supplier = F.coalesce(F.nullif("own_supplier", F.lit("")), F.nullif("brand", F.lit("")), F.col("file_supplier"))
    item = F.struct(
        F.col("item").alias("name"), F.col("code").alias("sku"), F.col("kind_of").alias("category"), supplier.alias("supplier"), F.coalesce(F.nullif("own_unit", F.lit("")), F.lit(UNIT)).alias("unit"),
        "cost", "listed", "least", F.when(F.col("listed") > 0, "fixed").otherwise("markup").alias("price_mode"), F.col("specs_text").alias("specs"), "current", "old",
        ((F.col("current") > 0) & F.coalesce(F.col("cost") == F.col("tier"), F.lit(False))).alias("used_tier"), N.subtotal_suspect(F.col("item"), F.col("code"), F.col("specs_text")).alias("subtotal"),
    )
    # a filter would be pushed down with every name spelled out in it, so rows are dropped by a generator
    return found.select("sheet", "idx", F.inline(F.filter(F.array(item), lambda _: kept)))

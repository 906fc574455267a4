"""Imports and quotes put together: line ids, gates, splits, merged and numbered lines, price updates, sanitised products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import cleaning as C
from tessella.functions import products as P
from tessella.functions.money import half_up, round_thousand
from tessella.functions.patterns import hits, joined
from tessella.functions.text import clean_text

# Words that let a list price be read from text; issues that stop a product whatever the user says.
LIST_WORDS = r"giá\s*(công\s*bố|cong\s*bo|niêm\s*yết|niem\s*yet|bán\s*lẻ|ban\s*le|giá\s*bán|gia\s*ban|giá\s*lẻ|gia\s*le)"
HARD = ("missing_product_name", "non_product_row")
HARD_WITHOUT_PRICE = ("price_parse_failed", "price_unreasonable")
BLOCKING = (*HARD, *HARD_WITHOUT_PRICE, "name_too_long")


def price_with_issue(value: Column, extra: Column) -> Column:
    """(price, issue) of a number: itself if sensible, else the least price of the extra text, else 0; issues say so."""
    whole = half_up(value)
    sensible, recovered = whole.between(P.LOWEST, P.HIGHEST), F.get(P.price_candidates(extra), F.lit(0))
    issue = F.when(sensible, None).when(recovered.isNotNull(), "price_recovered").otherwise("price_unreasonable")
    return F.struct(F.when(sensible, whole).otherwise(F.coalesce(recovered, F.lit(0))).cast("long").alias("price"), issue.alias("issue"))


def sanitise(products: DataFrame) -> DataFrame:
    """Products with cleaned fields, issue codes, status and confidence.

    products: id, name, sku, category, supplier, unit, cost, listed (0: none), specs, raw, accepted. Accepted ones keep
    only the issues that stop them whatever the user says.
    """
    split = C.split_name(F.col("name"), F.col("specs"))
    p = products.withColumn("s", split).withColumns({"short": C.without_weird(F.col("s.name")), "spec": C.without_weird(F.col("s.specs"))})
    p = p.withColumn("price", price_with_issue(F.col("cost"), F.concat_ws(" ", F.col("cost").cast("long").cast("string"), joined(F.col("spec"), F.col("raw")))))
    told = hits(joined(F.col("spec"), F.col("raw")), LIST_WORDS)
    p = p.withColumn("list_price", F.when((F.col("listed") > 0) | told, price_with_issue(F.col("listed"), joined(F.col("listed").cast("long").cast("string"), F.col("spec"), F.col("raw")))["price"]).otherwise(F.lit(0).cast("long")))
    found = P.best_code(joined(F.col("short"), F.col("spec"), F.col("raw")))
    own = C.without_weird(F.col("sku"))
    p = p.withColumns({"code": F.when(own != "", own).otherwise(found), "recovered": (own == "") & (found != "")})
    name = F.col("name")
    odd = clean_text(name).rlike(C.WEIRD) | hits(name, C.MOJIBAKE)
    note = C.not_a_product(joined(F.col("short"), F.col("spec"), F.col("raw")))
    issue = lambda condition, code, level: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level")))
    priced = F.struct(F.col("price.issue").alias("code"), F.when(F.col("price.issue") == "price_recovered", "warning").otherwise("error").alias("level"))
    issues = F.array_compact(
        F.array(
            issue(F.col("s.cut"), "split_specs_from_name", "info"), issue(F.col("s.long"), "name_too_long", "warning"), F.when(F.col("price.issue").isNotNull(), priced),
            issue((F.col("list_price") > 0) & (F.col("price.price") > 0) & (F.col("list_price") < F.col("price.price")), "list_price_below_cost", "warning"),
            issue(F.col("recovered"), "sku_extracted_from_text", "info"), issue(~F.col("accepted") & note, "non_product_row", "error"),
            issue(F.length("short") < 2, "missing_product_name", "error"), issue(~F.col("accepted") & odd, "weird_font", "warning"),
        )
    )
    stops = lambda i: i["code"].isin(*HARD) | (i["code"].isin(*HARD_WITHOUT_PRICE) & (F.col("price.price") <= 0))
    p = p.withColumn("issues", issues).withColumn("issues", F.when(F.col("accepted"), F.filter("issues", stops)).otherwise(F.col("issues")))
    has = lambda level: F.exists("issues", lambda i: i["level"] == level)
    status = F.when(has("error") | has("warning"), "review").otherwise("new")
    confidence = F.when(has("error"), 0.42).when(has("warning"), 0.64).when(F.col("accepted"), 0.9).otherwise(0.78)
    unsafe = F.when(F.col("accepted"), F.exists("issues", stops)).otherwise((status == "review") | has("error") | has("warning"))
    return p.select(
        "id", F.col("short").alias("name"), F.col("code").alias("sku"), F.col("price.price").alias("cost"), "list_price", F.when(F.col("list_price") > 0, "fixed").otherwise("markup").alias("price_mode"),
        C.clean_unit(F.col("unit")).alias("unit"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("issues"), status.alias("status"), confidence.alias("confidence"), unsafe.alias("unsafe"),
        F.exists("issues", lambda i: (i["level"] == "error") | i["code"].isin(*BLOCKING)).alias("blocking"),
    )


def preview_counts(rows: DataFrame, by: str) -> DataFrame:
    """Per group: clean rows, rows with warnings only, rows that block an import."""
    warned = (F.col("issues") != "") & ~F.col("blocking")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("blocking").alias("blocking"), F.count_if(warned).alias("warned"), F.count_if(~F.col("blocking") & ~warned).alias("clean"), F.count_if(~F.col("unsafe")).alias("importable"))


def line_id(*parts: Column) -> Column:
    """'line_' and the 32-bit FNV-1a hash of the joined parts, in base 36."""
    from tessella.functions.text import fnv1a

    return F.concat(F.lit("line_"), F.lower(F.conv(fnv1a(F.concat_ws("::", *parts)), 16, 36)))


def template_total(items: DataFrame, by: str, markup: float = 1.6) -> DataFrame:
    """Per template the sum of costs at a markup, rounded to thousands, times quantities."""
    return items.groupBy(by).agg(F.sum((round_thousand(F.col("cost") * markup) * F.col("qty")).cast("double")).alias("total"))


def merged_lines(lines: DataFrame, by: list[str], qty: str, order: str) -> DataFrame:
    """One line for equal keys with the sum of quantities, at the place of the first."""
    return lines.groupBy(*by).agg(F.sum(qty).alias("qty"), F.min(order).alias("place"))


def numbered(lines: DataFrame, quote: str, room: str, order: list[str]) -> DataFrame:
    """Line numbers that restart in each room, and those that go through the quote."""
    return lines.withColumns({
        "in_room": F.row_number().over(Window.partitionBy(quote, room).orderBy(*order)), "in_quote": F.row_number().over(Window.partitionBy(quote).orderBy(room, *order)),
    })


def nearest_before(rows: DataFrame, by: str, order: list[str], value: Column, within: int, into: str) -> DataFrame:
    """The nearest value that is not null among the `within` rows before."""
    over = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn(into, F.coalesce(*(F.lag(value, k).over(over) for k in range(1, within + 1))))


def batch_last_wins(rows: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """One row for keys that are equal up to case and outer blanks, separators kept: the values of the last; blank keys are dropped."""
    name = F.lower(F.trim(F.coalesce(F.col(key), F.lit(""))))
    found = rows.where(name != "").groupBy(name.alias("key")).agg(F.max(F.struct(order, *keep)).alias("row"), F.min(order).alias("place"))
    return found.select("key", "place", *(F.col(f"row.{c}").alias(c) for c in keep))


def replaced(rows: DataFrame, part: str, new: DataFrame) -> DataFrame:
    """The rows of all parts that have no new ones, and the new ones."""
    return rows.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def price_applied(catalog: DataFrame, feed: DataFrame, append: bool = True) -> DataFrame:
    """The catalogue with the feed's prices, rounded; with `append`, feed rows of unknown codes are added. Codes are equal up to case and outer blanks."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    prices = feed.where(key("sku") != "").groupBy(key("sku").alias("key")).agg(F.max_by("price", "pos").alias("price"), F.min("pos").alias("pos"))
    known = catalog.withColumn("key", key("sku")).join(prices, "key", "left")
    out = known.select("sku", F.coalesce(half_up(F.col("price")).cast("double"), F.col("cost")).alias("cost"), F.when(F.col("price").isNull(), "kept").otherwise("priced").alias("action"))
    if not append:
        return out
    fresh = prices.join(catalog.select(key("sku").alias("key")).distinct(), "key", "left_anti")
    return out.unionByName(fresh.select(F.col("key").alias("sku"), half_up(F.col("price")).cast("double").alias("cost"), F.lit("added").alias("action")))


def slash_list(values: Column, most: int = 8) -> Column:
    """The distinct parts of texts cut at slashes, commas and semicolons, whatever their case, the first `most`."""
    parts = F.filter(F.transform(F.flatten(F.transform(values, lambda v: F.split(v, r"\s*[/,;]\s*"))), lambda p: clean_text(p)), lambda p: p != "")
    low = F.transform(parts, lambda p: F.lower(p))
    first = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), (F.array_position(low, F.lower(p)) == i + 1).alias("first"))), lambda s: s["first"])
    return F.array_join(F.slice(F.transform(first, lambda s: s["p"]), 1, most), " / ")


def variant_diagnostics(variants: DataFrame, by: str) -> DataFrame:
    """Per quote: ready variants, best coverage, price spread, cheapest and dearest; the first of equal totals."""
    ready = variants.where("ready")
    low, high = F.min_by("variant", F.struct("total", "variant")), F.max_by("variant", F.struct("total", "variant"))
    return ready.groupBy(by).agg(F.count("*").alias("ready"), F.max("coverage").alias("best_coverage"), (F.max("total") - F.min("total")).alias("spread"), low.alias("lowest"), high.alias("highest"))

"""Products out of the HTML of pages: links with prices behind them, cards, lines of text.

An extractor cuts a page into its links, cards or lines, each a row with what stands around it,
and works on those rows. The cascade runs the later extractors only on pages that need them: those on
which links and cards give fewer than two products and nothing says that there is a list; single
lines are tried where even that gives fewer than three and the page is no article.

Windows are counted in characters. Every product found is kept, however many a page has. Pages without HTML have no products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import web as W
from tessella.functions.text import BOUNDARY, SPACES
from tessella.operators.staging import kept
from tessella.operators.survivors import best_items
from tessella.sources.json_products import page_products

let = W.let
#: Characters behind a link in which its price stands, and before it in which its image may stand.
BEHIND, BEFORE = 700, 1_400
#: Pieces of HTML that hold BEFORE characters at least: an empty link has seven.
PIECES = 2 * BEFORE // 7
# Shapes of links, cards and lists, buttons, signs of articles.
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
CARD = r"""(?is)<(li|article)\b[^>]*(?:class|id)=["'][^"']*(?:product|san-pham|woocommerce)[^"']*["'][^>]*>(.{40,9000}?)</\1>"""
IMAGE_TAG, IMAGE_TEXT = r"(?i)<img\b([^>]*)>", r"""(?i)<img[^>]+(?:alt|title)=["']([^"']{3,180})["']"""
BOX = r"""(?is)<div\b[^>]*(?:class|id)=["'][^"']*(?:product-small|product-card|product-item|product-grid|product-loop|wc-block-grid__product|item-product|san-pham)[^"']*["'][^>]*>(.{80,7000}?)</div>"""
BOX_PRICE = rf"""(?iu)(?:class=["'][^"']*price|₫|{BOUNDARY}vnđ{BOUNDARY}|{BOUNDARY}vnd{BOUNDARY})"""
NOT_NAMES, NOT_LINES = "(?iu)giỏ hàng|thêm vào|xem nhanh|mua ngay|add to cart", "(?iu)mua ngay|thêm vào|giỏ hàng|xem nhanh|chi tiết"
LIST_CLASS = r"""(?i)class=["'][^"']*(?:products|product-small|product-card|product-item|woocommerce-loop-product|wc-block-grid__product|add_to_cart_button)[^"']*["']"""
LIST_PRICE = rf"""(?iu)(?:₫|{BOUNDARY}vnđ{BOUNDARY}|{BOUNDARY}vnd{BOUNDARY}|class=["'][^"']*price)"""
LIST_LINK = r"""(?isu)<a\b[^>]+href=["'][^"']+\.html["'][^>]*>.{0,220}?(?:Công tắc|Đèn|Cảm biến|Module|Ổ cắm|Aptomat|Khóa|Rèm|Wallpad|Bộ điều khiển)"""
ARTICLE = "(?iu)(?:mục lục|lợi ích|lưu ý khi lựa chọn|thiết bị điện thông minh là gì|thương hiệu smarthome|cải thiện chất lượng cuộc sống)"
HEADING = rf"\n[{SPACES}]*(?:#{{1,4}}[{SPACES}]*)?[0-9]+(?:\.[0-9]+)*\.[{SPACES}]+"
NUMBERED, MORE, SOLD_OUT = rf"^[0-9]+(?:\.[0-9]+)*\.[{SPACES}]+", "(?iu)^xem thêm$", "(?iu)^hết hàng$"


def found_all(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(group))


def _named(rows: DataFrame, **columns) -> DataFrame:
    """Items in their final form, as of `json_products`; columns that aren't given are blank."""
    blank = F.lit("")
    get = lambda c: columns.get(c, blank)
    rows = rows.withColumns({"__name": columns["name"], "__raw": get("raw_text")})
    code = F.coalesce(F.nullif(get("sku"), blank), W.find_code(F.concat_ws(" ", "__name", "__raw")))
    return rows.select(
        "page_id", F.lit(columns["extractor"]).alias("extractor"), columns["place"].alias("place"), F.col("__name").alias("name"), W.clean_code(code).alias("sku"), blank.alias("brand"),
        F.coalesce(F.nullif(get("category"), blank), F.lit("Web catalog")).alias("category"), blank.alias("description"), get("image").alias("image"), columns["price"].alias("price"),
        W.absolute_url(F.coalesce(F.nullif(get("url"), blank), F.col("base")), F.col("base")).alias("url"), F.coalesce(F.nullif(F.col("__raw"), blank), F.col("__name")).alias("raw_text"),
        columns["confidence"].alias("confidence"),
    )


def linked_items(pages: DataFrame) -> DataFrame:
    """Links that name a product and have a price within 700 characters, before the next link.

    The image is the link's or stands behind it, else that of one of the four links before (to the same place, to nowhere, or of an image alone), else the last one of 1,400 characters before.
    """
    cleaned = F.regexp_replace(F.regexp_replace(W.text_of(F.col("html")), "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")

    def cut(c: Column) -> Column:
        tags, between = found_all(c, ANCHOR), F.split(c, ANCHOR, -1)
        return F.struct(tags.alias("tags"), between.alias("between"), F.flatten(F.zip_with(between, tags, lambda b, t: F.array(b, F.coalesce(t, F.lit(""))))).alias("pieces"))

    def around(s: Column) -> Column:
        return F.transform(s["tags"], lambda tag, k: F.struct(
            k.alias("k"), tag.alias("tag"), F.substring(F.get(s["between"], k + 1), 1, BEHIND).alias("behind"),
            F.right(F.array_join(F.slice(s["pieces"], F.greatest(2 * k + 2 - PIECES, F.lit(1)), F.least(2 * k + 1, F.lit(PIECES))), ""), F.lit(BEFORE)).alias("before"),
            F.reverse(F.slice(s["tags"], F.greatest(k - 3, F.lit(1)), F.least(k, F.lit(4)))).alias("earlier"),
        ))

    tag, base = F.col("tag"), F.col("base")
    attrs, inner = F.regexp_extract("tag", ANCHOR, 1), F.regexp_extract("tag", ANCHOR, 2)
    rows = pages.select("page_id", "base", F.inline(let(let(cleaned, cut), around)))
    rows = rows.withColumns({"attrs": attrs, "inner": W.clean_name(inner), "alt": W.clean_name(F.regexp_extract(inner, IMAGE_TEXT, 1))})
    title = F.coalesce(F.nullif(W.attribute(F.col("attrs"), "title"), F.lit("")), F.nullif(W.attribute(F.col("attrs"), "aria-label"), F.lit("")), F.nullif("inner", F.lit("")), F.col("alt"))
    rows = rows.withColumns({"name": W.clean_name(title), "href": W.attribute(F.col("attrs"), "href")})
    rows = rows.where(~((F.col("inner") == "") & (F.col("alt") != "")) & ~W.is_menu(F.col("name"), F.col("href"))).where(W.is_name(F.col("name")))
    rows = rows.withColumn("text", W.visible(F.col("behind"))).withColumn("priced", W.first_price(F.col("text"))).where("priced is not null")
    rows = rows.withColumns({"image": W.best_image(F.concat("tag", "behind"), base), "key": W.page_key(W.absolute_url(F.col("href"), base))})
    rows = kept(rows)
    missing = rows.where("image = ''").select("page_id", "k", "base", "key", "before", F.posexplode_outer("earlier").alias("back", "other"))
    missing = missing.withColumns({"found": W.best_image(F.col("other"), base), "other_key": W.page_key(W.absolute_url(W.attribute(F.regexp_extract("other", ANCHOR, 1), "href"), base))})
    other_inner = F.regexp_extract("other", ANCHOR, 2)
    alone = (W.clean_name(other_inner) == "") & (W.clean_name(F.regexp_extract(other_inner, IMAGE_TEXT, 1)) != "")
    fits = (F.col("found") != "") & ((F.col("key") == "") | (F.col("other_key") == "") | (F.col("key") == F.col("other_key")) | alone)
    near = missing.groupBy("page_id", "k").agg(F.min(F.when(fits, F.struct("back", "found")))["found"].alias("near"), F.first("before").alias("before"), F.first("base").alias("base"))
    near = near.select("page_id", "k", F.coalesce("near", W.last_image(F.col("before"), base)).alias("near"))
    rows = rows.drop("before", "earlier").join(near, ["page_id", "k"], "left").withColumn("image", F.coalesce("near", "image"))
    raw = W.trim(F.concat_ws(" ", "name", "text"))
    return _named(rows, extractor="linked", place=F.array(F.lit(0), F.col("k")), name=F.col("name"), price=F.col("priced.value"), image=F.col("image"), url=F.col("href"), raw_text=raw, confidence=F.lit(0.66))


def card_items(pages: DataFrame) -> DataFrame:
    """Products of list entries and articles whose class or id names products, then of boxes with a link, an image and a price.

    A card's name is, of its links' titles and texts and then its images' texts, the first that names a product; else its first fit line; else what stands before its price.
    """
    flat = F.replace(W.text_of(F.col("html")), F.lit("\n"), F.lit(" "))
    boxes = F.filter(found_all(flat, BOX, 1), lambda b: b.rlike(r"(?i)<a\b") & b.rlike(r"(?i)<img\b") & b.rlike(BOX_PRICE))
    rows = pages.select("page_id", "base", F.posexplode(F.concat(found_all(flat, CARD, 2), boxes)).alias("k", "block"))
    rows = rows.withColumn("raw", F.regexp_replace(W.visible(F.col("block")), "\n+", " · ")).withColumns({"priced": W.first_price(F.col("raw")), "sku": W.find_code(F.col("raw"))})
    rows = rows.where("priced is not null or sku <> ''")
    links = F.transform(found_all("block", ANCHOR), lambda t: F.array(W.attribute(F.regexp_extract(t, ANCHOR, 1), "title"), W.attribute(F.regexp_extract(t, ANCHOR, 1), "aria-label"), F.regexp_extract(t, ANCHOR, 2)))
    images = F.transform(found_all("block", IMAGE_TAG, 1), lambda t: F.array(W.attribute(t, "alt"), W.attribute(t, "title")))
    rows = rows.withColumn("names", F.transform(F.flatten(F.concat(links, images)), W.clean_name))
    rows = rows.withColumn("lines", F.transform(F.split(W.visible(F.col("block")), "\n"), W.clean_name))
    at = F.call_function("locate", F.col("priced.raw"), F.col("raw"))
    rest = F.when(at > 0, F.concat(F.substr("raw", F.lit(1), at - 1), F.substr("raw", at + F.length("priced.raw")))).otherwise(F.col("raw"))
    rows = rows.withColumn("rest", W.clean_name(F.get(F.split(rest, "·"), F.lit(0))))
    name = F.get(F.filter("names", lambda n: ~W.is_bad_name(n) & W.is_name(n)), F.lit(0))
    line = F.get(F.filter("lines", lambda n: F.length(n).between(4, 160) & ~W.is_bad_name(n) & ~n.rlike(NOT_LINES)), F.lit(0))
    rows = rows.withColumn("name", F.coalesce(name, line, F.when(~W.is_bad_name(F.col("rest")), F.col("rest")), F.lit(""))).where((F.col("name") != "") & ~F.col("name").rlike(NOT_NAMES))
    link = W.decode_entities(F.regexp_extract("block", r"""(?i)<a[^>]+href=["']([^"']+)["']""", 1))
    price = F.coalesce("priced.value", F.lit(0).cast("long"))
    return _named(rows, extractor="card", place=F.array(F.lit(1), F.col("k")), name=F.col("name"), sku=F.col("sku"), price=price, image=W.best_image(F.col("block"), F.col("base")), url=link, raw_text=F.col("raw"), confidence=F.when(price > 0, 0.58).otherwise(0.42))


def text_items(pages: DataFrame) -> DataFrame:
    """Lines that name a product with a price in one of the three lines below, before a heading; the category is the last line with "see more" under it."""
    lines = pages.select("page_id", "base", F.posexplode(F.filter(F.transform(F.split(W.visible(F.col("html")), "\n"), W.clean_name), lambda n: n != "")).alias("k", "line"))
    lines = lines.withColumns({"priced": W.first_price(F.col("line")), "more": F.col("line").rlike(MORE)})
    here = Window.partitionBy("page_id").orderBy("k")  # the lines of one page
    lines = lines.withColumn("ends", F.col("more") | F.col("line").rlike(NUMBERED))
    below = F.array(*(F.struct(F.lead("ends", i).over(here).alias("ends"), F.lead("line", i).over(here).alias("line"), F.lead("priced", i).over(here).alias("priced")) for i in (1, 2, 3)))
    heading = ~F.col("more") & F.col("priced").isNull() & F.coalesce(F.col("next_more"), F.lit(False))
    lines = lines.withColumns({"below": below, "next_more": F.lead("more", 1).over(here)}).withColumn("heading", heading)
    lines = lines.withColumn("category", F.last(F.when(F.col("heading"), F.col("line")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("first", F.get(F.filter("below", lambda b: b["ends"] | b["priced"].isNotNull()), F.lit(0)))
    rows = lines.where(~F.col("heading") & ~F.coalesce("next_more", F.lit(False)) & F.col("first").isNotNull() & ~F.col("first.ends")).where(W.is_name(F.col("line")) & ~W.is_menu(F.col("line"), F.lit("")) & ~F.col("line").rlike(SOLD_OUT))
    raw = F.concat_ws(" ", "line", "first.line")
    return _named(rows, extractor="text", place=F.array(F.lit(2), F.col("k")), name=F.col("line"), price=F.col("first.priced.value"), category=F.coalesce("category", F.lit("")), raw_text=raw, confidence=F.lit(0.62))


def line_items(pages: DataFrame) -> DataFrame:
    """Single lines with a name and a price."""
    lines = pages.select("page_id", "base", F.posexplode(F.transform(F.split(W.visible(F.col("html")), "\n"), W.trim)).alias("k", "line"))
    rows = lines.where(W.is_product_line(F.col("line"))).withColumn("name", W.clean_name(W.without_prices(F.col("line")))).where(W.is_name(F.col("name")))
    return _named(rows, extractor="line", place=F.array(F.lit(3), F.col("k")), name=F.col("name"), price=W.price_value(F.col("line")), raw_text=F.col("line"), confidence=F.lit(0.45))


def has_list(html: Column) -> Column:
    """Whether a page shows a list of products: two classes of products and two prices, or three links to products and three prices."""
    count = lambda pattern: F.size(found_all(html, pattern))
    return ((count(LIST_CLASS) >= 2) & (count(LIST_PRICE) >= 2)) | ((count(LIST_LINK) >= 3) & (count(LIST_PRICE) >= 3))


def is_article(html: Column) -> Column:
    text = F.substring(W.visible(html), 1, 9000)
    return let(text, lambda t: (F.size(found_all(t, HEADING)) >= 3) | t.rlike(ARTICLE))


def html_items(pages: DataFrame) -> DataFrame:
    """Products of pages (page_id, url, html) by the cascade: page_id, extractor, place (their order), and the item's fields."""
    page = pages.select("page_id", F.col("url").alias("base"), "html")
    strong = kept(best_items(kept(linked_items(page).unionByName(card_items(page)))))
    few = page.join(strong.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left").where((F.coalesce("n", F.lit(0)) < 2) & ~has_list(F.col("html")))
    lines = kept(text_items(few))
    fewer = few.join(lines.groupBy("page_id").agg(F.count("*").alias("m")), "page_id", "left").where((F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) < 3) & ~is_article(F.col("html")))
    return strong.unionByName(lines).unionByName(line_items(fewer))


def page_items(pages: DataFrame) -> DataFrame:
    """All products of pages: of their JSON, then of their HTML; those with a name or code and a price, image or code; one row for each name."""
    json = page_products(pages).withColumns({"extractor": F.when(F.col("script") < 1_000_000, "schema").otherwise("state"), "place": F.concat(F.array(F.lit(-1), F.col("script"), F.col("root")), "path")})
    every = json.drop("script", "root", "path").unionByName(html_items(pages))
    return best_items(kept(every).where("(name <> '' or sku <> '') and (price > 0 or image <> '' or sku <> '')"))

"""Queries over products in pages: JSON, links, cards and lines, images, rows merged by key.

Pages of shops are derived from the tables: each page keeps its own HTML (without digits, so that
nothing in it is a price) and gets the products of eight parts, in a shape that depends on its id.
The SQL never reads that HTML: it says from the parts which products must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import web as W
from tessella.operators import survivors
from tessella.plans.quoting import spread, table
from tessella.sources import cards, json_products

PARTS = 8
AMOUNT = "90000 + (p_partkey * 137) % 900000"
NAME = "concat(p_name, ' K', p_partkey)"
PRODUCT = (
    'concat(\'{"@type":"Product","name":"\', NAME, \'","sku":"SBX-\', p_partkey, \'","brand":{"name":"\', p_brand, \'"},"offers":[{"price":"\', AMOUNT, \'.00"}],"url":"/p/\', p_partkey, '
    '\'","image":["/uploads/\', p_partkey, \'.png"],"hasVariant":[{"@type":["Thing","Product"],"name":"\', NAME, \' XL","url":"../xl/\', p_partkey, \'","offers":{"lowPrice":\', AMOUNT + 500, \'.5}}]\')'
).replace("NAME", NAME).replace("AMOUNT", f"({AMOUNT})")
GROUPED = f"concat(cast(floor(({AMOUNT}) / 1000) as int), '.', lpad(cast(({AMOUNT}) % 1000 as string), 3, '0'), ' đ')"
CARDS = (
    f"concat('<div><a href=\"/p/', p_partkey, '.html\" title=\"', {NAME}, '\">more</a><span>', {GROUPED}, '</span></div>')",
    f"concat('<li class=\"product\"><img src=\"/logo.png\"><img data-src=\"/uploads/', p_partkey, '.png\" src=\"/s.gif\" alt=\"', {NAME}, '\"><b>', {NAME}, '</b> <span class=\"price\">', {GROUPED}, '</span></li>')",
    f"concat('<p>', {NAME}, '</p><p>', replace({GROUPED}, ' đ', ''), '</p>')",  # a line of a price with its currency is blank as a name
    f"concat('<p>', {NAME}, ' ', {GROUPED}, '</p>')",
)


def _shops(spark: SparkSession, sf_dir: str, piece: str, around: tuple[str, str]) -> DataFrame:
    """Pages with pieces for their parts, in the order of the parts, set between two texts."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") / PARTS).cast("long").alias("page_id"), "p_partkey", F.expr(piece).alias("piece"))
    pieces = part.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "piece"))).alias("p"))  # eight a page
    body = F.concat(F.expr(around[0]), F.array_join(F.transform("p", lambda x: x["piece"]), "§"), F.expr(around[1]))
    page = table(spark, sf_dir, "pages").join(pieces, "page_id")
    return page.select("page_id", "url", F.regexp_replace("html", "[0-9]", "").alias("own"), body.alias("body"))


def json_products_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in schema.org data: by page a graph, a list of items, or objects one after the other of which every third is broken; on even pages also in embedded state."""
    kind = "page_id % 3"
    product = f"concat({PRODUCT}, CASE WHEN p_partkey % 3 = 0 and (cast(p_partkey / {PARTS} as bigint)) % 3 = 2 THEN ']' ELSE '}}' END)"
    pages = _shops(spark, sf_dir, product, ("''", "''")).withColumn("p", F.split("body", "§"))
    joined = lambda pattern, between: F.array_join(F.transform("p", lambda x: F.concat(F.lit(pattern[0]), x, F.lit(pattern[1]))), between)
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), joined(("", ""), ","), F.lit("]}"))
    listed = F.concat(F.lit('[{"@type":"ItemList","itemListElement":['), joined(('{"@type":"ListItem","item":', "}"), ","), F.lit("]}]"))
    loose = F.array_join(F.transform("p", lambda x: F.concat(F.lit('{"@context":"x","@type":"Product",'), F.substr(x, F.lit(len('{"@type":"Product",') + 1)))), " ")
    ld = F.expr(f"CASE {kind} WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END")
    script = F.concat(F.lit('<script type="application/ld+json">'), F.when(ld == 0, graph).when(ld == 1, listed).otherwise(loose), F.lit("</script>"))
    state = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"page":[{"items":['), F.array_join(F.transform(F.filter("p", lambda x: x.endswith("}")), lambda x: F.concat(F.lit('{"title":'), F.regexp_extract(x, '"name":("[^"]*")', 1), F.lit(',"salePrice":'), F.regexp_extract(x, '"price":"([0-9]+)', 1), F.lit("}"))), ","), F.lit(']}]}}</script>'))
    html = F.concat(F.lit("<html><head>"), script, F.when(F.expr("page_id % 2 = 0"), state).otherwise(""), "own")
    found = json_products.page_products(pages.select("page_id", "url", html.alias("html")))
    return found.select("page_id", "script", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "name", "sku", "brand", "price", "image", F.when(F.col("confidence") > 0.8, F.col("url")).alias("url"))


def html_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in HTML by the cascade: links on every fourth page, cards, names above prices, single lines on the others."""
    piece = "CASE cast(p_partkey / {0} as bigint) % 4 {1} END".format(PARTS, " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(CARDS)))
    pages = _shops(spark, sf_dir, piece, ("'<section>'", "'</section>'"))
    html = F.concat(F.replace("body", F.lit("§"), F.lit("")), "own")
    found = cards.html_items(pages.select("page_id", "url", html.alias("html")))
    return found.select("page_id", "extractor", "name", "price", "image", F.when(F.col("extractor") == "linked", F.col("url")).alias("url"), F.col("confidence").cast("decimal(3,2)").cast("string").alias("confidence"))


IMAGES = (
    "concat('<img src=\"/a/', p_partkey, '.png\"><img src=\"/media/', p_partkey, '.png\">')",
    "concat('<img src=\"icon.png\" srcset=\"/s/', p_partkey, '.jpg 300w, /l/', p_partkey, '.jpg 900w\">')",
    "concat('<div style=\"background-image: url(/bg/', p_partkey, '.png)\"></div><img src=\"data:x\"><img src=\"/x.svg\">')",
    "concat('<img data-src=\"/first/', p_partkey, '.png\"><img data-src=\"/second/', p_partkey, '.png\">')",
)


def product_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image chosen of several tags, attributes and widths."""
    part = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr("CASE p_partkey % 4 {} END".format(" ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(IMAGES)))).alias("html"))
    return part.select("p_partkey", W.best_image(F.col("html"), F.lit("https://shop.example.com/list/")).alias("image"))


def rows_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one part merged: the last amounts above zero, the first image, all specifications up to 1,000 characters, six issues."""
    line = table(spark, sf_dir, "lineitem").select(
        F.expr("concat('part', l_partkey)").alias("key"), F.expr("l_orderkey * 10 + l_linenumber").alias("at_line"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE cast(l_quantity as bigint) END").alias("cost"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE 0 END").alias("listed"), F.expr("CASE WHEN l_orderkey % 5 = 0 THEN concat('/i/', l_orderkey, '.png') ELSE '' END").alias("image"),
        F.col("l_returnflag").alias("flag"), F.expr("CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('order ', l_orderkey) END").alias("specs"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN array(concat('i', l_orderkey), concat('j', l_orderkey)) ELSE cast(array() as array<string>) END").alias("issues"),
    )
    merged = survivors.merged_rows(line, F.col("key"), "at_line", ["cost", "listed"], ["image"], ["flag"])
    return merged.withColumn("issues", F.array_join("issues", ","))


QUERIES = {"json_products": json_products_query} | {f.__name__: f for f in (html_products, product_images, rows_merged)}
_PARTS = f"""with w as (select p_partkey, p_partkey // {PARTS} as page_id, regexp_replace(p_name, '^new ', '') || ' K' || p_partkey as name, p_brand, {AMOUNT} as amount, p_partkey % {PARTS} as i from part),
m as (select w.*, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) as origin, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) as folder from w join pages using (page_id))"""
_BROKEN = "p_partkey % 3 = 0 and page_id % 3 = 2"
ORACLES = {
    "json_products": f"""{_PARTS}, good as (select *, row_number() over (partition by page_id order by p_partkey) - 1 as g from m where not ({_BROKEN})),
seg as (select *, list_filter(string_split(regexp_replace(folder, '[^/]*$', ''), '/'), lambda s: s <> '') as up from good),
placed as (select *, CASE page_id % 3 WHEN 0 THEN '0,0,' || i WHEN 1 THEN '0,0,7,' || i ELSE '0' END as path,
  origin || '/' || array_to_string(list_concat(up[1:greatest(len(up) - 1, 0)], ['xl', CAST(p_partkey AS VARCHAR)]), '/') as up_url from seg)
select page_id, 0 as script, CASE WHEN page_id % 3 = 2 THEN CAST(g AS INTEGER) ELSE 0 END as root, path, name, 'SBX-' || p_partkey as sku, p_brand as brand, amount as price, origin || '/uploads/' || p_partkey || '.png' as image, origin || '/p/' || p_partkey as url from placed
union all select page_id, 0, CASE WHEN page_id % 3 = 2 THEN CAST(g AS INTEGER) ELSE 0 END, path || ',2,0', name || ' XL', '', '', amount + 501, '', up_url from placed
union all select page_id, 1000000, 0, '0,0,0,0,0,' || g, name, '', '', amount, '', NULL from placed where page_id % 2 = 0""",
    "html_products": f"""{_PARTS}
select page_id, CASE page_id % 4 WHEN 0 THEN 'linked' WHEN 1 THEN 'card' WHEN 2 THEN 'text' ELSE 'line' END as extractor, name, amount as price,
  CASE WHEN page_id % 4 = 1 THEN origin || '/uploads/' || p_partkey || '.png' ELSE '' END as image, CASE WHEN page_id % 4 = 0 THEN origin || '/p/' || p_partkey || '.html' END as url,
  CASE page_id % 4 WHEN 0 THEN '0.66' WHEN 1 THEN '0.58' WHEN 2 THEN '0.62' ELSE '0.45' END as confidence from m""",
    "product_images": """select p_partkey, 'https://shop.example.com/' || CASE p_partkey % 4 WHEN 0 THEN 'media/' || p_partkey || '.png' WHEN 1 THEN 'l/' || p_partkey || '.jpg'
  WHEN 2 THEN 'bg/' || p_partkey || '.png' ELSE 'first/' || p_partkey || '.png' END as image from part""",
    "rows_merged": """with l as (select 'part' || l_partkey as key, l_orderkey * 10 + l_linenumber as at_line, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END as cost,
  CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE 0 END as listed, CASE WHEN l_orderkey % 5 = 0 THEN '/i/' || l_orderkey || '.png' ELSE '' END as image, l_returnflag as flag,
  CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'order ' || l_orderkey END as specs, CASE WHEN l_linenumber % 2 = 0 THEN ['i' || l_orderkey, 'j' || l_orderkey] ELSE [] END as issues from lineitem),
g as (select key, min(at_line) as place, count(*) as n_rows, max_by(flag, at_line) as flag, max_by(cost, at_line) filter (where cost <> 0) as cost, max_by(listed, at_line) filter (where listed <> 0) as listed,
  min_by(image, at_line) filter (where image <> '') as image, string_agg(specs, ' | ' order by at_line) filter (where specs <> '') as specs, flatten(list(issues order by at_line)) as issues from l group by key)
select key, place, n_rows, flag, coalesce(cost, 0) as cost, coalesce(listed, 0) as listed, coalesce(image, '') as image,
  coalesce(CASE WHEN n_rows > 1 THEN substr(specs, 1, 1000) ELSE specs END, '') as specs, array_to_string(CASE WHEN n_rows > 1 THEN issues[1:6] ELSE issues END, ',') as issues from g""",
}

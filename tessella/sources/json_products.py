"""Products out of JSON in pages: schema.org data and the state that page builders embed.

JSON of unknown shape is parsed to VARIANT. A fold inside each row walks it level by
level: its state are the products found and the nodes still to visit, and it takes as
many steps as the text has brackets (embedded state: nine levels), so nothing is
shuffled, and a page's work is bounded by its own JSON. A product's place is
its path from the root, so items come in the order in which a recursive walk meets them.
Keys of embedded objects are visited in the order of their names, as VARIANT keeps them.
JSON that doesn't parse as a whole is cut before each object that begins with
``"@context"``; pieces that don't parse either are left out, and so are nulls and pages
without JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import web as W

#: Levels of embedded state that are visited, the root among them.
LEVELS = 9
# Where a schema.org node's children are, in order, and the names of an item's fields.
CHILDREN = ("@graph", "itemListElement", "hasVariant", "isVariantOf", "offers", "mainEntity", "mainEntityOfPage")
SCHEMA_CONFIDENCE, EMBEDDED_CONFIDENCE = 0.86, 0.68
NAMES, PRICES = ("name", "title", "productName"), ("price", "salePrice", "finalPrice", "regularPrice", "priceNumber")
LD_JSON = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
STATES = tuple(rf"""(?is)<script[^>]+id=["']{name}["'][^>]*>(.*?)</script>""" for name in ("__NEXT_DATA__", "__NUXT_DATA__"))
CUT = f"[{W.SPACES}]*(?=\\{{[{W.SPACES}]*\"@context\"|\\[[{W.SPACES}]*\\{{[{W.SPACES}]*\"@context\")"

let = W.let


def get(node: Column, key: str) -> Column:
    return F.try_variant_get(node, f"$['{key}']", "variant")


def elements(node: Column) -> Column:
    """Elements of an array; null for anything else."""
    return F.when(F.schema_of_variant(node).startswith("ARRAY"), F.try_variant_get(node, "$", "array<variant>"))


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def is_number(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def scalar(node: Column) -> Column:
    """Text of a string or number; null for anything else."""
    return F.when(is_number(node) | (F.schema_of_variant(node) == "STRING"), F.try_variant_get(node, "$", "string"))


def truthy(node: Column) -> Column:
    """The node unless it is absent, null, false, zero or an empty string."""
    text = F.schema_of_variant(node)
    empty = (text == "VOID") | ((text == "BOOLEAN") & ~F.coalesce(F.try_variant_get(node, "$", "boolean"), F.lit(False))) | (is_number(node) & (F.try_variant_get(node, "$", "double") == 0)) | ((text == "STRING") & (F.try_variant_get(node, "$", "string") == ""))
    return F.when(~F.coalesce(empty, F.lit(True)), node)


def first_truthy(node: Column, *keys: str) -> Column:
    return F.coalesce(*(let(get(node, k), truthy) for k in keys))


def text(node: Column, *keys: str) -> Column:
    """The first of several fields with a text: a string, a number, or the name, title, value or id of an object (not of an object in it); '' without."""
    plain = lambda v: F.nullif(W.trim(scalar(v)), F.lit(""))
    one = lambda v: F.coalesce(plain(v), F.when(is_object(v), F.coalesce(*(let(get(v, k), plain) for k in ("name", "title", "value", "@id")))))
    return F.coalesce(*(let(get(node, k), one) for k in keys), F.lit(""))


def first_of(node: Column) -> Column:
    """The node, or the first element of an array, twice over."""
    for _ in range(2):
        node = let(node, lambda n: F.when(elements(n).isNotNull(), F.get(elements(n), F.lit(0))).otherwise(n))
    return node


def field(node: Column, *keys: str) -> Column:
    """Text of a node that is itself a string or number, or of an object's first key with one."""
    return let(first_of(node), lambda n: F.coalesce(F.nullif(W.trim(scalar(n)), F.lit("")), F.when(is_object(n), text(n, *keys)), F.lit("")))


def price(node: Column) -> Column:
    """A number rounded half up, else the first price in a text, else 0."""
    number = F.floor(F.try_variant_get(node, "$", "double") + 0.5).cast("long")
    return F.coalesce(F.when(is_number(node), number).otherwise(W.first_price(scalar(node))["value"]), F.lit(0).cast("long"))


def offer_price(offers: Column) -> Column:
    def use(o: Column) -> Column:
        inner = F.coalesce(first_truthy(o, "price", "lowPrice", "highPrice"), get(get(o, "priceSpecification"), "price"))
        return F.when(is_object(o), let(inner, price)).otherwise(price(o))

    return let(first_of(offers), use)


def _item(node: Column, path: Column, schema: bool) -> Column:
    names = ("name", "headline") if schema else NAMES
    codes = ("sku", "mpn", "productID", "model") if schema else ("sku", "code", "model", "mpn")
    cost = offer_price(get(node, "offers")) if schema else let(first_truthy(node, *PRICES), price)
    image = get(node, "image") if schema else first_truthy(node, "image", "images", "thumbnail", "featuredImage")
    return F.struct(
        path.alias("path"), text(node, *names).alias("name"), text(node, *codes).alias("sku"), field(first_truthy(node, "brand", "manufacturer"), "name", "title", "brand").alias("brand"),
        text(node, *(("category",) if schema else ("category", "categoryName"))).alias("category"),
        text(node, *(("description",) if schema else ("description", "shortDescription", "summary"))).alias("description"),
        field(image, "url", "contentUrl", "src", "secure_url").alias("image"), cost.alias("price"),
        text(node, *(("url",) if schema else ("url", "slug", "path", "href"))).alias("url"), text(node, *(("name", "sku", "description") if schema else ("name", "title", "sku", "price"))).alias("raw_text"),
    )


def _kind(node: Column) -> Column:
    """The type of a schema.org node, several as one text."""
    types = get(node, "@type")
    listed = F.try_variant_get(types, "$", "array<string>")
    return F.coalesce(F.when(elements(types).isNotNull(), F.array_join(listed, " ")).otherwise(scalar(types)), F.lit(""))


def _numbered(nodes: Column, path: Column, first: int = 0) -> Column:
    return F.transform(nodes, lambda v, k: F.struct(F.concat(path, F.array(k + first)).alias("path"), v.alias("node")))


def _walk(root: Column, steps: Column, item, products, children) -> Column:
    """Products of all nodes from a root on, by path."""
    start = F.array(F.struct(F.array(F.lit(0)).alias("path"), root.alias("node")))
    none = F.filter(F.array(item(F.parse_json(F.lit("{}")), F.array(F.lit(0)))), lambda _: F.lit(False))
    state = F.struct(none.alias("found"), start.alias("open"))
    step = lambda s, _: F.struct(F.concat(s["found"], products(s["open"])).alias("found"), F.flatten(F.transform(s["open"], children)).alias("open"))
    return F.array_sort(F.aggregate(F.sequence(F.lit(1), steps), state, step, lambda s: s["found"]))


def schema_products(root: Column, steps: Column) -> Column:
    """Products of a schema.org value: nodes whose type names a product, at any depth below the known keys."""
    item = lambda node, path: _item(node, path, True)
    none = F.filter(F.array(F.struct(F.array(F.lit(0)).alias("path"), F.parse_json(F.lit("null")).alias("node"))), lambda _: F.lit(False))

    def children(n: Column) -> Column:
        node, path = n["node"], n["path"]
        keyed = F.array(*(F.struct(F.concat(path, F.array(F.lit(k))).alias("path"), truthy(get(node, key)).alias("node")) for k, key in enumerate(CHILDREN)))
        listed = F.transform(elements(get(node, "itemListElement")), lambda v: F.coalesce(truthy(get(v, "item")), v))
        of_list = F.when(_kind(node).contains("ItemList") & listed.isNotNull(), _numbered(listed, F.concat(path, F.array(F.lit(len(CHILDREN)))))).otherwise(none)
        of_object = F.when(is_object(node), F.filter(F.concat(keyed, of_list), lambda c: c["node"].isNotNull())).otherwise(none)
        return F.coalesce(_numbered(elements(node), path), of_object)

    products = lambda open_: F.transform(F.filter(open_, lambda n: is_object(n["node"]) & _kind(n["node"]).rlike("(?i)product")), lambda n: item(n["node"], n["path"]))
    return _walk(root, steps, item, products, children)


def embedded_products(root: Column) -> Column:
    """Products of embedded state: the members of arrays in which two objects at least have a name and a price, image or code."""
    item = lambda node, path: _item(node, path, False)
    none = F.filter(F.array(F.struct(F.array(F.lit(0)).alias("path"), F.parse_json(F.lit("null")).alias("node"))), lambda _: F.lit(False))
    is_product = lambda v: is_object(v) & first_truthy(v, *NAMES).isNotNull() & first_truthy(v, "price", "salePrice", "regularPrice", "image", "sku").isNotNull()
    of = lambda node: F.filter(elements(node), is_product)

    def products(open_: Column) -> Column:
        found = F.filter(open_, lambda n: F.coalesce(F.size(of(n["node"])) >= 2, F.lit(False)))
        return F.flatten(F.transform(found, lambda n: F.transform(_numbered(of(n["node"]), n["path"]), lambda m: item(m["node"], m["path"]))))

    def children(n: Column) -> Column:
        node, path = n["node"], n["path"]
        values = F.map_values(F.when(is_object(node), F.try_variant_get(node, "$", "map<string,variant>")))
        inner = F.when(F.coalesce(F.size(of(node)) >= 2, F.lit(False)), none).otherwise(F.coalesce(_numbered(elements(node), path), _numbered(values, path), none))
        return F.filter(inner, lambda c: truthy(c["node"]).isNotNull())

    return _walk(root, F.lit(LEVELS), item, products, children)


def parsed(raw: Column) -> Column:
    """A script's JSON values: the whole, else its pieces that parse."""
    plain = F.regexp_replace(F.regexp_replace(W.text_of(raw), f"^[{W.SPACES}]*<!\\[CDATA\\[", ""), f"\\]\\]>[{W.SPACES}]*$", "")
    whole = W.trim(W.decode_entities(plain))

    def one(t: Column) -> Column:  # the parser stops after a first value, so the text must also be one between brackets
        return F.when(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).isNotNull() & (t != ""), get(F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))), "v"))

    def use(t: Column) -> Column:
        pieces = F.filter(F.transform(F.split(t, CUT), one), lambda v: v.isNotNull())
        return let(one(t), lambda v: F.when(v.isNotNull(), F.array(v)).otherwise(pieces))

    return let(whole, use)


def _finished(rows: DataFrame, base: str, confidence: float) -> DataFrame:
    """Items in their final form: names and codes cleaned, addresses absolute, a code found in the text where none is given."""
    p = F.col("p")
    named = rows.withColumn("item_name", W.clean_name(p["name"]))
    code = F.coalesce(F.nullif(p["sku"], F.lit("")), W.find_code(F.concat_ws(" ", "item_name", p["raw_text"])))
    url = W.absolute_url(F.coalesce(F.nullif(p["url"], F.lit("")), F.col(base)), F.col(base))
    category = F.coalesce(F.nullif(W.clean_name(p["category"]), F.lit("")), F.lit("Web catalog"))
    raw = F.coalesce(F.nullif(p["raw_text"], F.lit("")), F.col("item_name"))
    return named.select(
        "page_id", "script", "root", p["path"].alias("path"), F.col("item_name").alias("name"), W.clean_code(code).alias("sku"), W.clean_name(p["brand"]).alias("brand"), category.alias("category"),
        W.clean_description(p["description"]).alias("description"), W.absolute_url(p["image"], F.col(base)).alias("image"), p["price"].alias("price"), url.alias("url"), raw.alias("raw_text"), F.lit(confidence).alias("confidence"),
    )


def page_products(pages: DataFrame) -> DataFrame:
    """Items of all JSON in pages (page_id, url, html): page_id, script, root, path (their order), and the item's fields.

    `script` counts a page's schema.org scripts from 0; embedded state comes after them as 1000000 and 1000001.
    """
    page = pages.select("page_id", F.col("url").alias("base"), "html")
    ld = F.transform(F.regexp_extract_all(W.text_of(F.col("html")), F.lit(LD_JSON), F.lit(1)), lambda raw, k: F.struct(k.alias("script"), raw.alias("raw")))
    scripts = page.select("page_id", "base", F.inline(ld))
    roots = scripts.select("page_id", "base", "script", F.size(F.regexp_extract_all("raw", F.lit(r"[\[{]"), F.lit(0))).alias("steps"), F.posexplode(parsed(F.col("raw"))).alias("root", "value"))
    found = roots.select("page_id", "base", "script", "root", F.explode(schema_products(F.col("value"), F.col("steps") + 1)).alias("p"))
    state = F.array(*(F.struct(F.lit(1_000_000 + k).alias("script"), F.regexp_extract(W.text_of(F.col("html")), s, 1).alias("raw")) for k, s in enumerate(STATES)))
    states = page.select("page_id", "base", F.inline(F.filter(state, lambda s: s["raw"] != "")))
    more = states.select("page_id", "base", "script", F.posexplode(parsed(F.col("raw"))).alias("root", "value"))
    more = more.select("page_id", "base", "script", "root", F.explode(embedded_products(F.col("value"))).alias("p"))
    return _finished(found, "base", SCHEMA_CONFIDENCE).unionByName(_finished(more, "base", EMBEDDED_CONFIDENCE))

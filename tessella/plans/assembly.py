"""Queries that put imports and quotes together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import cleaning as C
from tessella.functions import inference
from tessella.functions import money as M
from tessella.functions import products as P
from tessella.functions.text import clean_text
from tessella.operators import assembly as A
from tessella.plans import cleaning as Q
from tessella.plans import sql as S
from tessella.plans.quoting import spread, table

RAW, COST, LISTED = S.pick("p_size", ["", "Giá niêm yết 5.290.000", "Thanh toán 30 ngày", "LM-ST7 7.200.000", "giao hàng"]), "CASE WHEN p_partkey % 3 = 0 THEN 12.0 WHEN p_partkey % 3 = 1 THEN 2000000000000.0 ELSE p_retailprice * 1000 END", "CASE WHEN p_partkey % 4 = 0 THEN p_retailprice * 900 ELSE 0.0 END"


def _sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr(
        "p_partkey as id", f"{Q.NAME} as name", f"CASE WHEN p_size % 2 = 0 THEN '' ELSE {Q.SKU} END as sku", f"{Q.CATEGORY} as category", "p_brand as supplier", f"{Q.UNIT} as unit",
        f"CAST({COST} AS DOUBLE) as cost", f"CAST({LISTED} AS DOUBLE) as listed", f"{Q.SPEC} as specs", f"{RAW} as raw", "p_partkey % 5 = 0 as accepted",
    )
    return A.sanitise(items)


def sanitised_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sanitised(spark, sf_dir)


def preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.preview_counts(_sanitised(spark, sf_dir), "price_mode")


def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", A.line_id(F.lit("list.xlsx"), F.col("p_brand"), F.lit(""), F.col("p_partkey").cast("string"), F.lit(""), F.col("p_name"), F.col("p_size").cast("string")).alias("line_id"))


PERCENTS = ["+5,5 %", "-7.5%", "12", "abc", " 3,25% ", ""]
AMOUNTS = ["1,5 bộ", "12", "05/06/2024", "0", "-3", "abc", "1,000"]


def money_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale and list prices, percentages, quantities, display of amounts, collapsed white space."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_size % 3 = 0 as fixed", "p_retailprice * 1000 as cost", "CASE WHEN p_size % 4 = 0 THEN 0.0D ELSE p_retailprice * 1700 END as listed", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 10.0D END as factor", f"{S.pick('p_partkey', PERCENTS)} as percent", f"{S.pick('p_partkey', AMOUNTS)} as amount", "concat('  ', p_name, '   x ') as label")
    sale = M.sale_price(F.when(F.col("fixed"), "fixed").otherwise("markup"), F.col("cost"), F.col("listed"), F.col("factor"))
    return part.select(
        "id", sale.alias("sale"), M.first_price(F.col("listed"), F.col("cost")).alias("price"), M.vnd(F.floor(F.col("cost"))).alias("shown"), M.bulk_percent(F.col("percent")).alias("percent"), P.quantity(F.col("amount")).alias("qty"), clean_text(F.col("label")).alias("label")
    )


def template_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").selectExpr("p_type as template", "p_retailprice as cost", "p_size as qty")
    return A.template_total(items, "template")


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return A.merged_lines(lines, ["l_partkey", "l_returnflag"], "l_quantity", "l_orderkey")


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    found = A.numbered(lines, "l_orderkey", "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return found.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "in_room", "in_quote")


def nearest_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = A.nearest_before(events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("value")), 4, "before")
    return found.select("event_id", "before")


def batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as pos", "CASE WHEN p_size % 7 = 0 THEN '  ' WHEN p_size % 2 = 0 THEN upper(concat(' ', p_name, '-', p_brand)) ELSE concat(p_name, '-', p_brand) END as sku", "p_type")
    return A.batch_last_wins(part, "sku", "pos", ["p_type"])


def sheets_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of suppliers' sheets; those of the dearest brand-sheets come anew from an extractor."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as sheet", "p_partkey as id", "'rules' as engine")
    new = table(spark, sf_dir, "part").where("p_size >= 49").selectExpr("p_brand as sheet", "p_partkey as id", "'model' as engine")
    return A.replaced(rows, "sheet", new).groupBy("sheet", "engine").agg(F.count("*").alias("n"))


def prices_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    catalog = part.where("p_size <= 40").selectExpr("concat('P-', p_partkey) as sku", "CAST(p_retailprice AS DOUBLE) as cost")
    feed = part.selectExpr("p_partkey as pos", "CASE WHEN p_size % 9 = 0 THEN ' ' WHEN p_size % 2 = 0 THEN concat(' p-', p_partkey) ELSE concat('P-', p_partkey + 100000000) END as sku", "p_retailprice * 1.1 as price")
    return A.price_applied(catalog, feed)


def supplier_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "array(concat(p_name, ' / ', p_type), concat(upper(p_type), ',', p_brand, ';;x'), p_name) as v")
    return part.select("id", A.slash_list(F.col("v"), 3).alias("names"))


def variant_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey as customer", "o_orderpriority as variant", "o_totalprice as total", "o_orderstatus")
    variants = orders.groupBy("customer", "variant").agg(F.sum("total").alias("total"), F.floor(F.avg(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0)) + 0.5).cast("long").alias("coverage"))
    found = A.variant_diagnostics(variants.withColumn("ready", F.col("total") > 50_000), "customer")
    return found.withColumn("spread", F.round("spread", 2))


def review_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier the rows by status, the share to review, and whether a second engine is needed: more than four tenths, or a weak column map."""
    items = table(spark, sf_dir, "part").selectExpr("p_brand as supplier", f"{S.pick('p_size', ['matched', 'new', 'review', 'rejected', 'matched'])} as status", "0.4D + p_size / 100.0D as map_confidence")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = items.groupBy("supplier").agg(n("matched"), n("new"), n("review"), n("rejected"), F.count("*").alias("n"), F.min("map_confidence").alias("map_confidence"))
    share = (F.col("review") + F.col("rejected")) / F.col("n")
    return counts.withColumn("share", F.round(share, 6)).withColumn("fallback", (share > 0.4) | (F.col("map_confidence") < 0.5))


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a model answered surely for a known product, and the rest, which are counted by what they lack."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END as product", f"{S.pick('l_linenumber', ['high', 'medium', 'low', ''])} as sure")
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.lit(True).alias("known"))
    found = rows.join(known, "product", "left").withColumn("taken", F.col("sure").isin("high", "medium") & F.coalesce("known", F.lit(False)))
    return found.groupBy("taken", "sure", F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


def web_items_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a name or code, and a price, picture or code; scored by what they have."""
    items = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END as name", "CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END as sku", "CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0 END as price", "CASE WHEN p_size % 7 = 0 THEN 'a.jpg' ELSE '' END as image")
    kept = ((F.col("name") != "") | (F.col("sku") != "")) & ((F.col("price") > 0) | (F.col("image") != "") | (F.col("sku") != ""))
    quality = F.when(F.col("price") > 0, 2).otherwise(0) + F.when(F.col("image") != "", 1).otherwise(0) + F.when(F.col("sku") != "", 1).otherwise(0)
    return items.where(kept).select("id", quality.alias("quality"))


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no returned line has, and customers without a pending order."""
    parts = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return parts.union(customers.select(F.lit("customer"), "c_custkey"))


ROOMS = ["II. Bếp", "I. Khách", "X. Sân", "IV. Ngủ", "Khác", "VIII. Tầng hầm"]


def quote_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a solution merged by product, in rooms of roman order and then of first appearance; empty rooms are left out."""
    lines = table(spark, sf_dir, "part").selectExpr("p_partkey as pos", f"coalesce({S.pick('p_size', ROOMS)}, 'Khác') as room", "p_name as product", "coalesce(p_size, 0) as qty", "p_brand as note")
    merged = lines.groupBy("room", "product").agg(F.sum("qty").alias("qty"), F.min_by("note", "pos").alias("note"), F.min("pos").alias("pos")).where("qty > 0")
    first = merged.groupBy("room").agg(F.min("pos").alias("first"))
    return merged.join(first, "room").select("room", inference.roman_order(F.col("room")).alias("roman"), "first", "product", "qty", "note")


_RAWS = f"i as (select p_partkey as id, {Q.NAME} as name, CASE WHEN p_size % 2 = 0 THEN '' ELSE {Q.SKU} END as sku, {Q.UNIT} as unit, CAST({COST} AS DOUBLE) as cost, CAST({LISTED} AS DOUBLE) as listed, {Q.SPEC} as specs, {RAW} as raw, p_partkey % 5 = 0 as accepted from part)"
_least = lambda x: f"list_min({S.prices(x)})"


def _score(c: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({c}, '[-_/]') THEN 8 ELSE 0 END + CASE WHEN regexp_matches({c}, '^[A-Z]{{2,}}[-_/]') THEN 4 ELSE 0 END + CASE WHEN regexp_matches({c}, '^[A-Z]{{2,}}[0-9]') THEN 2 ELSE 0 END"
        f" + CASE WHEN length({c}) between 6 and 22 THEN 2 ELSE 0 END - CASE WHEN length({c}) > 28 THEN 3 ELSE 0 END + CASE WHEN regexp_matches({c}, '{P.KNOWN_CODES}') THEN 2 ELSE 0 END) * 1000 - length({c})"
    )


_SAN = f"""{_RAWS}, n as (select *, {S.flat('name')} as fn, {S.flat('specs')} as fs, regexp_extract({S.flat('name')}, {S.quoted('(?i)^(.*?)' + C.SPEC_WORDS)}, 1) as head from i),
c as (select *, {S.hit('fn', C.SPEC_WORDS)} and length(head) > 6 and length(trim(head)) >= 4 as cut from n),
d as (select *, {S.flat(f"regexp_replace(CASE WHEN cut THEN trim(head) ELSE fn END, '{C.WEIRD}', '', 'g')")} as short,
  {S.flat(f"regexp_replace(CASE WHEN cut and fs <> '' THEN trim(substr(fn, length(head) + 1)) || ' | ' || fs WHEN cut THEN trim(substr(fn, length(head) + 1)) ELSE fs END, '{C.WEIRD}', '', 'g')")} as spec, length(CASE WHEN cut THEN trim(head) ELSE fn END) > 130 as long from c),
e as (select *, {S.joined('spec', 'raw')} as sr, {S.joined('short', 'spec', 'raw')} as whole, floor(cost + 0.5) as r, {S.flat(f"regexp_replace(sku, '{C.WEIRD}', '', 'g')")} as own from d),
f as (select *, r between 1000 and 1000000000 as sensible, {_least("CAST(cost AS BIGINT)::VARCHAR || ' ' || sr")} as rec, {_least(S.joined('CAST(listed AS BIGINT)::VARCHAR', 'sr'))} as lrec, list_distinct({S.codes('whole')}) as cs, {S.codes('whole')} as ordered from e),
g as (select *, CAST(CASE WHEN sensible THEN r ELSE coalesce(rec, 0) END AS BIGINT) as price, CASE WHEN sensible THEN NULL WHEN rec is not null THEN 'price_recovered' ELSE 'price_unreasonable' END as pi,
  CAST(CASE WHEN listed > 0 or {S.hit('sr', A.LIST_WORDS)} THEN CASE WHEN floor(listed + 0.5) between 1000 and 1000000000 THEN floor(listed + 0.5) ELSE coalesce(lrec, 0) END ELSE 0 END AS BIGINT) as list_price,
  coalesce(list_filter(ordered, lambda c: {_score('c')} = list_max(list_transform(ordered, lambda d: {_score('d')})))[1], '') as found from f),
h as (select *, CASE WHEN own <> '' THEN own ELSE found END as code, list_filter([
  CASE WHEN cut THEN 'split_specs_from_name' END, CASE WHEN long THEN 'name_too_long' END, pi, CASE WHEN list_price > 0 and price > 0 and list_price < price THEN 'list_price_below_cost' END, CASE WHEN own = '' and found <> '' THEN 'sku_extracted_from_text' END,
  CASE WHEN not accepted and ({S.hit('whole', C.CONTACT)} or ({S.hit('whole', C.NON_PRODUCT)} and not (len({S.codes('whole')}) > 0 and len({S.prices('whole')}) > 0))) THEN 'non_product_row' END, CASE WHEN length(short) < 2 THEN 'missing_product_name' END,
  CASE WHEN not accepted and ({S.hit('fn', C.WEIRD)} or {S.hit('name', C.MOJIBAKE)}) THEN 'weird_font' END], lambda v: v is not null) as every from g),
k as (select *, CASE WHEN accepted THEN list_filter(every, lambda v: v in ('missing_product_name', 'non_product_row') or (v in ('price_parse_failed', 'price_unreasonable') and price <= 0)) ELSE every END as iss from h),
m as (select *, len(list_intersect(iss, ['price_unreasonable', 'non_product_row', 'missing_product_name'])) > 0 as err, len(list_intersect(iss, ['name_too_long', 'price_recovered', 'list_price_below_cost', 'weird_font'])) > 0 as warn from k),
z as (select id, short as name, code as sku, price as cost, list_price, CASE WHEN list_price > 0 THEN 'fixed' ELSE 'markup' END as price_mode, CASE WHEN {S.flat('unit')} = '' or length({S.flat('unit')}) > 18 or {S.hit(S.flat('unit'), C.WEIRD)} THEN 'Cái' ELSE {S.flat('unit')} END as unit,
  array_to_string(iss, ',') as issues, CASE WHEN err or warn THEN 'review' ELSE 'new' END as status, CASE WHEN err THEN 0.42::DOUBLE WHEN warn THEN 0.64::DOUBLE WHEN accepted THEN 0.9::DOUBLE ELSE 0.78::DOUBLE END as confidence,
  CASE WHEN accepted THEN len(iss) > 0 ELSE err or warn END as unsafe, err or list_contains(iss, 'name_too_long') as blocking from m)"""
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(w) + 1), lambda i: ord(substr(w, i, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_B36 = "ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, k) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), ''), '0')"

QUERIES = {
    f.__name__: f
    for f in (
        sanitised_products, preview_counts, line_ids, money_fields, template_totals, merged_lines, line_numbers, nearest_click, batch_dedupe, sheets_replaced, prices_applied, supplier_areas, variant_spread, review_share, page_totals,
        confidence_gate, web_items_kept, unmatched, quote_rooms,
    )
}
ORACLES = {
    "sanitised_products": f"with {_SAN} select * from z",
    "preview_counts": f"with {_SAN} select price_mode, count(*) as n, count(*) filter (blocking) as blocking, count(*) filter (issues <> '' and not blocking) as warned, count(*) filter (issues = '') as clean, count(*) filter (not unsafe) as importable from z group by 1",
    "line_ids": f"with w as (select p_partkey, concat_ws('::', 'list.xlsx', p_brand, '', p_partkey::VARCHAR, '', p_name, p_size::VARCHAR) as w from part), h as (select p_partkey, {_FNV} as h from w) select p_partkey, 'line_' || {_B36} as line_id from h",
    "money_fields": f"""with p as (select p_partkey as id, p_size % 3 = 0 as fixed, p_retailprice * 1000 as cost, CASE WHEN p_size % 4 = 0 THEN 0.0::DOUBLE ELSE p_retailprice * 1700 END as listed, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / 10.0::DOUBLE END as factor,
  {S.pick('p_partkey', PERCENTS)} as percent, {S.pick('p_partkey', AMOUNTS)} as amount, '  ' || p_name || '   x ' as label from part), q as (select *, TRY_CAST(nullif(regexp_extract(replace(trim(amount), ',', '.'), '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) as v from p)
select id, CASE WHEN fixed THEN listed ELSE floor(cost * coalesce(nullif(factor, 0), 1.0) / 1000 + 0.5) * 1000 END as sale, coalesce(nullif(listed, 0), nullif(cost, 0), 0.0) as price, replace(format('{{:,}}', CAST(floor(cost) AS BIGINT)), ',', '.') as shown,
  TRY_CAST(trim(replace(replace(trim(percent), '%', ''), ',', '.')) AS DOUBLE) as percent, CASE WHEN not regexp_matches(amount, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') and v > 0 and v <= 100000 THEN v END as qty, {S.flat('label')} as label from q""",
    "template_totals": "select p_type as template, sum(floor(p_retailprice * 1.6::DOUBLE / 1000 + 0.5) * 1000 * p_size) as total from part group by 1",
    "merged_lines": "select l_partkey, l_returnflag, sum(l_quantity) as qty, min(l_orderkey) as place from lineitem group by 1, 2",
    "line_numbers": "select l_orderkey, l_returnflag, l_linenumber, l_partkey, CAST(row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) as in_room, CAST(row_number() over (partition by l_orderkey order by l_returnflag, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) as in_quote from lineitem",
    "nearest_click": "select event_id, coalesce(" + ", ".join(f"lag(CASE WHEN event_type = 'click' THEN value END, {k}) over (partition by user_id order by ts, event_id)" for k in range(1, 5)) + ") as before from events",
    "batch_dedupe": """with p as (select p_partkey as pos, lower(trim(CASE WHEN p_size % 7 = 0 THEN '  ' WHEN p_size % 2 = 0 THEN upper(' ' || p_name || '-' || p_brand) ELSE p_name || '-' || p_brand END)) as key, p_type from part)
select key, min(pos) as place, arg_max(p_type, pos) as p_type from p where key <> '' group by 1""",
    "sheets_replaced": "with n as (select p_brand as sheet from part where p_size >= 49) select p_brand as sheet, 'rules' as engine, count(*) as n from part where p_brand not in (select sheet from n) group by 1 union all select sheet, 'model', count(*) from n group by 1",
    "prices_applied": """with c as (select lower('P-' || p_partkey) as key, 'P-' || p_partkey as sku, p_retailprice as cost from part where p_size <= 40),
f as (select lower(trim(CASE WHEN p_size % 9 = 0 THEN ' ' WHEN p_size % 2 = 0 THEN ' p-' || p_partkey ELSE 'P-' || (p_partkey + 100000000) END)) as key, p_retailprice * 1.1::DOUBLE as price from part)
select c.sku, coalesce(floor(f.price + 0.5), c.cost) as cost, CASE WHEN f.price is null THEN 'kept' ELSE 'priced' END as action from c left join f using (key)
union all select key, floor(price + 0.5), 'added' from f where key <> '' and key not in (select key from c)""",
    "supplier_areas": f"""with p as (select p_partkey as id, list_filter(list_transform(flatten(list_transform([p_name || ' / ' || p_type, upper(p_type) || ',' || p_brand || ';;x', p_name], lambda v: regexp_split_to_array(v, '\\s*[/,;]\\s*'))), lambda v: trim(v)), lambda v: v <> '') as v from part)
select id, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i)[:3], ' / ') as names from p""",
    "variant_spread": """with v as (select o_custkey as customer, o_orderpriority as variant, sum(o_totalprice) as total, CAST(floor(avg(CASE WHEN o_orderstatus = 'F' THEN 100.0::DOUBLE ELSE 0 END) + 0.5) AS BIGINT) as coverage from orders group by 1, 2)
select customer, count(*) as ready, max(coverage) as best_coverage, round(max(total) - min(total), 2) as spread, first(variant order by total, variant) as lowest, first(variant order by total desc, variant desc) as highest from v where total > 50000 group by 1""",
    "review_share": f"""with i as (select p_brand as supplier, {S.pick('p_size', ['matched', 'new', 'review', 'rejected', 'matched'])} as status, 0.4::DOUBLE + p_size / 100.0::DOUBLE as m from part),
c as (select supplier, count(*) filter (status = 'matched') as matched, count(*) filter (status = 'new') as new, count(*) filter (status = 'review') as review, count(*) filter (status = 'rejected') as rejected, count(*) as n, min(m) as map_confidence from i group by 1)
select *, round((review + rejected)::DOUBLE / n, 6) as share, (review + rejected)::DOUBLE / n > 0.4 or map_confidence < 0.5 as fallback from c""",
    "page_totals": "select source, count(*) as pages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) as chars from documents group by 1",
    "confidence_gate": f"""with r as (select l_partkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END as product, {S.pick('l_linenumber', ['high', 'medium', 'low', ''])} as sure from lineitem), k as (select r.*, p_partkey is not null as known from r left join part on p_partkey = product)
select sure in ('high', 'medium') and known as taken, sure, known, count(*) as n from k group by 1, 2, 3""",
    "web_items_kept": """with i as (select p_partkey as id, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END as name, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END as sku, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0 END as price, CASE WHEN p_size % 7 = 0 THEN 'a.jpg' ELSE '' END as image from part)
select id, CASE WHEN price > 0 THEN 2 ELSE 0 END + CASE WHEN image <> '' THEN 1 ELSE 0 END + CASE WHEN sku <> '' THEN 1 ELSE 0 END as quality from i where (name <> '' or sku <> '') and (price > 0 or image <> '' or sku <> '')""",
    "unmatched": "select 'part' as kind, p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R') union all select 'customer', c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "quote_rooms": f"""with l as (select p_partkey as pos, coalesce({S.pick('p_size', ROOMS)}, 'Khác') as room, p_name as product, coalesce(p_size, 0) as qty, p_brand as note from part),
m as (select room, product, CAST(sum(qty) AS BIGINT) as qty, arg_min(note, pos) as note, min(pos) as pos from l group by 1, 2 having sum(qty) > 0)
select room, CASE regexp_extract(room, '^(I{{1,3}}|IV|V|VI{{0,3}}|IX|X)\\.', 1) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 WHEN 'VI' THEN 6 WHEN 'VII' THEN 7 WHEN 'VIII' THEN 8 WHEN 'IX' THEN 9 WHEN 'X' THEN 10 ELSE 99 END as roman,
  min(pos) over (partition by room) as first, product, qty, note from m""",
}

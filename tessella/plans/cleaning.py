"""Queries that make imported fields fit for a catalogue: names, categories, suppliers, units, row classes, whole products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import cleaning as C
from tessella.functions import naming as N
from tessella.functions import products as P
from tessella.operators import rows as R
from tessella.plans import sql as S
from tessella.plans.quoting import table

# Texts as imports have them, one to a part by its number.
NAMES = [
    "Khóa cửa DDL702 Chất liệu hợp kim kẽm", "Công tắc LM-1G2W-C(G) Công suất 500W", "Bộ điều khiển", "Tên □ lỗi font", "Ãm thanh đa vùng", "x Model 1", "Đèn", "đen/trắng",
    "Vân tay, Mật mã, Thẻ từ", "L 450*300*250", "SBX501-4C0", "Camera", "  Rèm   thông minh  ", "Công tắc thông minh.", "Mã khóa sử dụng: OSN-3381, OSN-KBT06", "",
]
CATEGORIES = ["Khóa thông minh", "BẢNG BÁO GIÁ", "", "Tổng hợp", "Đèn led", "Khác", "Thiết bị ▯ vệ sinh", "Ổ cắm âm tường"]
SUPPLIERS = ["Công ty ABC", "Ngân hàng VCB", "", "Hotline 0900", "Lumi Việt Nam", "NCC ◆", "Philips"]
UNITS = ["bộ", "", "cái □", "một đơn vị tính rất dài", "m"]
PLACES = ["KÉT PHILIPS", "KHÓA BIỆT THỰ", "Lumi lighting", "", "Cảm biến Aqara", "SSE HOME"]
SPECS = ["", "Nguồn 12V", "mở khóa vân tay", "abc", "Giá niêm yết 5.290.000", "12.500.000 / 9.900.000"]
ROWS = [
    "Thi công: Hoàn thành sau 7 ngày kể từ ngày ký hợp đồng", "Tổng cộng", "Tổng tiền 12.000.000", "I. KHÓA THÔNG MINH", "Nhóm đèn", "- gạch đầu dòng", "Công tắc LM-S4 1.200.000", "Bảo hành DDL-702 5.000.000",
    "stt", "", "CAMERA", "Đèn 450.000", "Chiết khấu 10%", "SBX501-4C0 két", "ab", "thuế VAT 8%",
]
MORE = ["", "1.200.000", "Tên", "7", "12500000", "ghi chú"]

NAME, CATEGORY, SUPPLIER, UNIT = S.pick("p_partkey", NAMES), S.pick("p_partkey", CATEGORIES), S.pick("p_partkey", SUPPLIERS), S.pick("p_partkey", UNITS)
PLACE, SPEC, SKU = S.pick("p_size", PLACES), S.pick("p_size", SPECS), S.pick("p_partkey + p_size", ["", "LM-S4", "n/a", "K20 – 5", "SBX501-4C0 | 25 kg", "DDL702 3,5kg"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", f"{NAME} as name", f"{CATEGORY} as category", f"{SUPPLIER} as supplier", f"{UNIT} as unit", f"{PLACE} as place", f"{SPEC} as specs", f"{SKU} as sku", "p_name", "p_brand", "p_size"
    )


I = f"i as (select p_partkey as id, {NAME} as name, {CATEGORY} as category, {SUPPLIER} as supplier, {UNIT} as unit, {PLACE} as place, {SPEC} as specs, {SKU} as sku, p_name, p_brand, p_size from part)"  # noqa: E741


def split_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return items.select("id", C.split_name(F.concat_ws(" ", "name", "p_name"), F.col("specs")).alias("s")).select("id", "s.*")


def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return items.select(
        "id", C.clean_category(F.col("category")).alias("category"), C.clean_supplier(F.col("supplier"), F.col("p_brand")).alias("supplier"), C.clean_unit(F.col("unit")).alias("unit"),
        C.without_weird(F.col("name")).alias("name"), F.round(C.weird_share(F.col("name")), 6).alias("weird"),
    )


def non_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"concat({S.pick('p_partkey', ROWS)}, ' ', {S.pick('p_size', MORE)}) as text")
    return rows.select("id", C.not_a_product(F.col("text")).alias("dropped"))


def inferred_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return items.select("id", C.infer_category(*(F.col(c) for c in ("category", "name", "sku", "specs", "place", "supplier", "p_name"))).alias("category"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumns({"model": N.model_text(F.col("sku")), "brand": N.brand_of(F.col("place"), F.col("p_name"), F.col("supplier"))})
    items = items.withColumn("kind", N.type_of(F.col("place"), F.col("p_name"), F.col("specs"), F.col("model"), F.col("category")))
    shown = N.display_name(F.col("name"), F.col("model"), F.col("kind"), F.col("brand"))
    return items.select("id", "model", "brand", "kind", shown.alias("shown"), N.must_derive_name(F.col("name"), F.col("model")).alias("derived"), N.subtotal_suspect(F.col("name"), F.col("model"), F.col("specs")).alias("subtotal"))


def name_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    feature = F.concat_ws("/", "name", "specs", "p_name", "p_brand")
    return items.select(
        "id", N.short_feature(feature).alias("feature"), N.hidden_code(F.array("place", "name", "sku")).alias("hidden"), N.with_spec(F.col("specs"), F.col("name")).alias("specs"),
        N.colour_only(F.col("name")).alias("colour"), N.specs_only(F.col("name")).alias("specs_only"), N.generic_name(F.col("name")).alias("generic"),
    )


CELLS = [S.pick("p_partkey", ROWS), S.pick("p_size", MORE), S.pick("p_partkey + p_size", ["", "", "Mã", "5", "x"])]


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as sheet", "p_partkey as idx", f"array({', '.join(CELLS)}) as text")
    return rows.withColumn("class", R.row_class(F.col("text")))


def row_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_sections(_sheet(spark, sf_dir), "sheet", "idx").select("sheet", "idx", "class", "section")


def sheet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extraction_stats(_sheet(spark, sf_dir), "sheet")


_FLAT, _CAT = S.flat("x"), S.flat("category")
_BROKEN = lambda x: f"({S.hit(S.flat(x), C.WEIRD)} or {S.hit(S.flat(x), C.MOJIBAKE)})"
_NOT = lambda x: f"({S.hit(x, C.CONTACT)} or ({S.hit(x, C.NON_PRODUCT)} and not (len({S.codes(x)}) > 0 and len({S.prices(x)}) > 0)))"
_MODEL = rf"""CASE WHEN {S.hit(S.flat('sku'), N.NO_MODEL)} THEN '' ELSE {S.flat(r"regexp_replace(regexp_replace(regexp_replace(sku, '\s*[-–—]\s*', '-', 'g'), '(?i)\s*\|\s*\d+(?:[.,]\d+)?\s*(kg|kgs|g|gram)\b.*$', ''), '(?i)\s+\d+(?:[.,]\d+)?\s*(kg|kgs|g|gram)\b.*$', '')")} END"""
_NEAR = S.joined("name", "sku", "place", "supplier")
_ALL = S.joined("name", "sku", "specs", "place", "supplier", "p_name")
_GENERIC = f"replace(strip_accents(trim(regexp_replace(lower({S.flat('name')}), '[.\\s]+$', ''))), 'đ', 'd') in ({', '.join(map(S.quoted, N.GENERIC_NAMES))})"
_COLOUR = S.hit(S.flat("name"), rf"^({N.COLOURS})([\s\/,\-]*({N.COLOURS}))*$")
_SPECS_ONLY = f"({S.hit(S.flat('name'), N.SPEC_ONLY)} or {S.hit(S.flat('name'), N.DIMENSIONS)} or length({S.flat('name')}) > 115)"
_FILLED = "list_filter(t, lambda c: coalesce(c, '') <> '')"
_SHEET = f"""raw as (select p_brand as sheet, p_partkey as idx, [{', '.join(CELLS)}] as t from part),
j as (select *, array_to_string({_FILLED}, ' ') as x, len({_FILLED}) as filled from raw),
m as (select *, coalesce(list_max(flatten(list_transform(t, lambda c: {S.prices('c')}))), 0) as money, len({S.codes('x')}) > 0 as coded from j),
k as (select *, CASE WHEN x = '' THEN 'blank' WHEN {_NOT('x')} THEN 'note'
  WHEN len(list_intersect(list_transform(t, lambda c: trim(lower(coalesce(c, '')))), [{', '.join(map(S.quoted, R.HEADER_CELLS))}])) >= 2
    and len(list_filter(t, lambda c: regexp_matches(c, '^[0-9.,\\s]+$') and regexp_matches(c, '[0-9]'))) <= 1 THEN 'header'
  WHEN {S.hit('x', R.TOTALS)} THEN 'total' WHEN {S.hit('x', R.NOTES)} and not (money > 0 and coded) THEN 'note'
  WHEN regexp_matches(x, '{R.BULLET}') and money = 0 THEN 'note'
  WHEN money = 0 and filled <= 2 and length(x) <= 60 and ((x = upper(x) and regexp_matches(x, '[A-ZĐÀ-Ỹ]')) or {S.hit('x', R.SECTION)}) THEN 'section'
  WHEN money >= 100 and length(x) >= 3 THEN 'product' WHEN coded and length(x) >= 5 THEN 'product' WHEN money >= 100 THEN 'product' ELSE 'note' END as class from m)"""

QUERIES = {f.__name__: f for f in (split_specs, clean_fields, non_products, inferred_categories, display_names, name_features, row_classes, sheet_stats)}
ORACLES = {
    "split_specs": f"""with {I}, n as (select id, {S.flat("name || ' ' || p_name")} as n, {S.flat('specs')} as s from i),
h as (select *, regexp_extract(n, {S.quoted('(?i)^(.*?)' + C.SPEC_WORDS)}, 1) as head from n),
c as (select *, {S.hit('n', C.SPEC_WORDS)} and length(head) > 6 and length(trim(head)) >= 4 as cut from h)
select id, CASE WHEN cut THEN trim(head) ELSE n END as name, CASE WHEN cut and s <> '' THEN trim(substr(n, length(head) + 1)) || ' | ' || s WHEN cut THEN trim(substr(n, length(head) + 1)) ELSE s END as specs,
  cut, length(CASE WHEN cut THEN trim(head) ELSE n END) > 130 as long from c""",
    "clean_fields": f"""with {I} select id,
  CASE WHEN {_CAT} = '' or {_BROKEN('category')} or length({_CAT}) > 60 or {S.hit(_CAT, C.CATEGORY_JUNK)} THEN 'Chung' ELSE {_CAT} END as category,
  CASE WHEN supplier = '' or {_BROKEN('supplier')} or length(supplier) > 80 or {S.hit('supplier', C.CONTACT)} or {S.hit('supplier', C.CATEGORY_JUNK)} THEN p_brand ELSE {S.flat('supplier')} END as supplier,
  CASE WHEN {S.flat('unit')} = '' or length({S.flat('unit')}) > 18 or {_BROKEN('unit')} THEN 'Cái' ELSE {S.flat('unit')} END as unit,
  {S.flat(f"regexp_replace(name, '{C.WEIRD}', '', 'g')")} as name,
  round(CASE WHEN {S.flat('name')} = '' THEN 0.0::DOUBLE ELSE (length({S.flat('name')}) - length(regexp_replace({S.flat('name')}, '{C.WEIRD}', '', 'g')))::DOUBLE / length({S.flat('name')}) END, 6) as weird from i""",
    "non_products": f"with r as (select p_partkey as id, {S.pick('p_partkey', ROWS)} || ' ' || {S.pick('p_size', MORE)} as x from part), f as (select id, {S.flat('x')} as x from r) select id, {_NOT('x')} as dropped from f",
    "inferred_categories": f"""with {I} select id, coalesce(
  CASE WHEN {_CAT} <> '' and not {S.hit(_CAT, C.PLACEHOLDER_CATEGORY)} and length({_CAT}) <= 60 and not {S.either(_CAT, C.BAD_CATEGORY)} THEN {_CAT} END,
  {S.first_of(_NEAR, C.CATEGORY_RULES, S.either)}, {S.first_of(_ALL, C.CATEGORY_RULES, S.either)}, 'Chung') as category from i""",
    "display_names": f"""with {I}, m as (select *, {_MODEL} as model, coalesce({S.first_of(S.plain("place || ' ' || p_name || ' ' || supplier"), N.BRANDS)}, '') as brand from i),
k as (select *, coalesce({S.first_of(S.plain('category'), N.TYPES_BY_CATEGORY)}, {S.first_of(S.plain('model'), N.TYPES_BY_CODE)},
  {S.first_of(S.plain("p_name || ' ' || place"), N.TYPES_BY_PLACE)}, {S.first_of(S.plain('specs'), N.TYPES_BY_SPECS)}, 'Sản phẩm') as kind from m)
select id, model, brand, kind, CASE WHEN model = '' THEN {S.flat('name')} ELSE {S.joined('kind', f"CASE WHEN contains({S.plain('model')}, {S.plain('brand')}) THEN '' ELSE brand END", 'model')} END as shown,
  model <> '' and ({S.flat('name')} = '' or {S.flat('name')} = model or {_COLOUR} or {_SPECS_ONLY}) as derived, model = '' and length({S.flat('specs')}) < 4 and {_GENERIC} as subtotal from k""",
    "name_features": f"""with {I}, f as (select *, name || '/' || specs || '/' || p_name || '/' || p_brand as feature,
  {S.codes('place')} as a, {S.codes('name')} as b, {S.codes('sku')} as c from i),
p as (select *, list_filter(list_transform(string_split(feature, '/'), lambda v: trim(v)), lambda v: v <> '') as parts from f)
select id, CASE WHEN len(parts) <= 3 THEN substr(feature, 1, 50) ELSE parts[1] || '/' || parts[2] || '/' || parts[3] || '...' END as feature,
  CASE WHEN len(a) > 0 THEN a[-1] WHEN len(b) > 0 THEN b[-1] WHEN len(c) > 0 THEN c[-1] ELSE '' END as hidden,
  CASE WHEN {S.flat('name')} = '' or contains({S.plain('specs')}, {S.plain('name')}) THEN specs WHEN specs = '' THEN {S.flat('name')} ELSE specs || ' · ' || {S.flat('name')} END as specs,
  {_COLOUR} as colour, {_SPECS_ONLY} as specs_only, {_GENERIC} as generic from p""",
    "row_classes": f"""with {_SHEET} select sheet, idx, class, coalesce(last_value(CASE WHEN class = 'section' THEN trim(regexp_replace(x, '(?i)^(?:[IVX]+|[A-Z])[.)]\\s*', '')) END ignore nulls)
  over (partition by sheet order by idx rows between unbounded preceding and current row), '') as section from k""",
    "sheet_stats": f"""with {_SHEET} select sheet, count(*) as n_rows, {', '.join(f"count(*) filter (class = '{c}') as n_{c}" for c in R.CLASSES)}, count(*) filter (class not in ('product', 'section')) as n_skipped from k group by 1""",
}

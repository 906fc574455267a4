"""Items of the catalogue's sheets in a dozen layouts, priced and named by each sheet's column map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.functions import cleaning as C
from tessella.functions import naming as N
from tessella.functions import products as P
from tessella.operators import columns as M
from tessella.operators import items as I
from tessella.plans import columns as L
from tessella.plans import sql as S
from tessella.plans.quoting import spread, table

PLACE = {
    "sheet_name": S.pick("p_partkey", ["KÉT PHILIPS", "Bảng giá OSUNO", "KHÓA BIỆT THỰ", "", "Sheet1"]),
    "section": S.pick("p_size", ["", "Công tắc", "KHÓA NHÔM KÍNH", "Camera", "II"]), "file_supplier": S.pick("p_size", ["Lumi", "Philips VN", "", "NĐ"]),
}
_CONTEXT = ", ".join(f"{x} as {c}" for c, x in PLACE.items())


def sheet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, rows = L._sheets(spark, sf_dir)
    place = spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr(f"{L.SHEET} as sheet", "p_partkey as idx", f"{L._text('array(', ')')} as text", *(f"{x} as {c}" for c, x in PLACE.items()))
    return I.sheet_items(place, I.price_labels(M.map_columns(headers, rows), headers))


def _best(x: str) -> str:
    points = "CASE WHEN regexp_matches(c, '[-_/]') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(c, '^[A-Z]{2,}[-_/]') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(c, '^[A-Z]{2,}[0-9]') THEN 2 ELSE 0 END" \
        f" + CASE WHEN length(c) between 6 and 22 THEN 2 ELSE 0 END - CASE WHEN length(c) > 28 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(c, '{P.KNOWN_CODES}') THEN 2 ELSE 0 END"  # fmt: skip
    return f"coalesce(list_sort(list_transform({S.codes(x)}, lambda c, i: {{'s': -({points}), 'l': length(c), 'i': i, 'c': c}}))[1].c, '')"


def _model(x: str) -> str:
    weight = r"\d+(?:[.,]\d+)?\s*(kg|kgs|g|gram)\b.*$"
    bare = rf"regexp_replace({S.flat(x)}, '\s*[-–—]\s*', '-', 'g')"
    return f"CASE WHEN {S.hit(S.flat(x), N.NO_MODEL)} THEN '' ELSE {S.flat(rf'''regexp_replace(regexp_replace({bare}, '(?i)\s*\|\s*{weight}', ''), '(?i)\s+{weight}', '')''')} END"


def _kind(specs: str, code: str, category: str) -> str:
    place = "trim(section || ' ' || sheet_name)"
    return f"coalesce({S.first_of(S.plain(category), N.TYPES_BY_CATEGORY)}, {S.first_of(S.plain(code), N.TYPES_BY_CODE)}, {S.first_of(S.plain(place), N.TYPES_BY_PLACE)}, {S.first_of(S.plain(specs), N.TYPES_BY_SPECS)}, 'Sản phẩm')"


def _with(specs: str, more: str) -> str:
    return f"CASE WHEN {more} is null or contains({S.plain(specs)}, {S.plain(more)}) THEN {specs} WHEN {specs} = '' THEN {S.flat(more)} ELSE {specs} || ' · ' || {S.flat(more)} END"


_AT = lambda f: f"coalesce(trim(t[{f} + 1]), '')"
_P = lambda x: f"coalesce(list_min({S.prices(x)}), 0)"
_VND = lambda label, x: f"{label} || ': ' || replace(format('{{:,}}', {x}), ',', '.') || 'đ'"
_CELLS = lambda cols: f"list_filter(list_transform({cols}, lambda k: {S.flat('t[k + 1]')}), lambda k: k <> '')"
_NEAR = S.joined("item", "code", "section", "sheet_name", "file_supplier")
_ALL = S.joined("item", "code", "specs", "section", "sheet_name", "file_supplier", "raw")
_OWN = S.flat("cat")
_BAD = lambda x: f"({x} = '' or length({x}) > 60 or {S.either(x, C.BAD_CATEGORY)})"
_LABELLED = rf"regexp_replace(regexp_replace(regexp_replace(ftext, {S.quoted('(?i)' + I.CODE_LABEL)}, ' ', 'g'), '\b\d{{1,3}}(?:[.,]\d{{3}}){{1,4}}\b', ' ', 'g'), '\b\d{{5,10}}\b', ' ', 'g')"
_COLOUR = lambda x: S.hit(S.flat(x), rf"^({N.COLOURS})([\s\/,\-]*({N.COLOURS}))*$")
_BRANDED = lambda code: f"CASE WHEN contains({S.plain(code)}, {S.plain('brand')}) THEN '' ELSE brand END"
_ITEM = S.flat("item")
_GENERIC = f"replace(strip_accents(trim(regexp_replace(lower({_ITEM}), '[.\\s]+$', ''))), 'đ', 'd') in ({', '.join(map(S.quoted, N.GENERIC_NAMES))})"

QUERIES = {"sheet_items": sheet_items}
ORACLES = {
    "sheet_items": f"""with maps as ({L.ORACLES['column_map']}), heads(sheet, h) as (values {L._HEADS}),
place as (select {L.SHEET} as sheet, p_partkey as idx, {L._text('[', ']')} as t, {_CONTEXT} from part),
a as (select p.*, m.* exclude (sheet, name, sku, specs, unit, category, supplier), nullif(trim(h[current_price + 1]), '') as label, m.name as name_col, m.sku as sku_col,
  {_AT('m.name')} as item, {_AT('m.sku')} as own_sku, {_AT('m.specs')} as specs, {_AT('m.unit')} as unit, {_AT('m.category')} as cat, {_AT('m.supplier')} as sup,
  array_to_string(list_filter(t, lambda k: coalesce(k, '') <> ''), ' ') as raw from place p join maps m on p.sheet = m.sheet left join heads h on p.sheet = h.sheet),
b as (select *, {_model('own_sku')} as code0, coalesce(list_filter(list_transform({_CELLS('hidden_sku_cols')}, lambda k: {S.codes('k')}), lambda k: len(k) > 0)[1][-1], '') as hid,
  {_P('t[price + 1]')} as asked, {_P('t[list_price + 1]')} as old, {_P('t[current_price + 1]')} as current, {_P('t[least_price + 1]')} as least, {_P('t[other_price + 1]')} as other,
  list_transform(t, lambda k: {_P('k')}) as every from a),
c as (select *, CASE WHEN code0 <> '' THEN code0 ELSE {_model('hid')} END as code1, list_min(list_filter(list_transform(tier_cols, lambda k: every[k + 1]), lambda k: k >= 1000 and (current = 0 or k <= current * 1.05::DOUBLE))) as tier,
  list_min(list_filter(list_transform(every, lambda k, i: CASE WHEN list_contains(list_concat([name_col, sku_col, list_price, current_price, least_price], tier_cols), CAST(i - 1 AS INTEGER)) THEN 0 ELSE k END), lambda k: k > 0)) as loose from b),
d as (select *, CASE WHEN current > 0 THEN CASE WHEN asked > 0 and price is distinct from current_price and price is distinct from list_price and price is distinct from least_price THEN asked ELSE coalesce(tier, current) END
  WHEN asked = 0 THEN coalesce(tier, 0) ELSE asked END as cost0, CASE WHEN current > 0 THEN current WHEN old > 0 THEN old ELSE other END as listed from c),
e as (select * replace ({_with('specs', 's1')} as specs), CASE WHEN cost0 = 0 THEN coalesce(loose, 0) ELSE cost0 END as cost, CASE WHEN current > 0 THEN {_VND(f"coalesce(label, '{I.CURRENT_PRICE}')", 'current')} END as s2
  from (select *, CASE WHEN current > 0 and old > 0 and old <> current THEN {_VND(f"'{I.OLD_PRICE}'", 'old')} END as s1 from d)),
f as (select * replace ({_with('specs', 's2')} as specs) from e),
g as (select *, list_concat(name_source_cols, list_filter(feature_cols, lambda k: not list_contains(name_source_cols, k))) as more from f),
h as (select * replace (array_to_string(list_filter(list_prepend(specs, list_filter({_CELLS('more')}, lambda k: k <> specs and k <> item)[1:3]), lambda k: k <> ''), ' | ') as specs) from g),
i as (select * replace (CASE WHEN least > 0 and specs = '' THEN {_VND(f"'{I.LEAST_PRICE}'", 'least')} WHEN least > 0 THEN specs || ' · ' || {_VND(f"'{I.LEAST_PRICE}'", 'least')} ELSE specs END as specs) from h),
j as (select *, {_best(S.joined('item', 'specs', 'raw'))} as spoken from i),
k as (select *, CASE WHEN code1 <> '' THEN code1 ELSE {_model('spoken')} END as code, coalesce({S.first_of(S.plain("sheet_name || ' ' || section || ' ' || file_supplier"), N.BRANDS)}, '') as brand,
  coalesce({_CELLS('feature_cols')}[1], {_CELLS('name_source_cols')}[1], '') as ftext from j),
l as (select *, CASE WHEN section <> '' THEN section ELSE {_kind('specs', 'code', "''")} END as fb, {S.flat(_LABELLED)} as f1 from k),
m as (select *, coalesce(CASE WHEN {_OWN} <> '' and not {S.hit(_OWN, C.PLACEHOLDER_CATEGORY)} and not {_BAD(_OWN)} THEN {_OWN} END, {S.first_of(_NEAR, C.CATEGORY_RULES, S.either)}, {S.first_of(_ALL, C.CATEGORY_RULES, S.either)},
  CASE WHEN {_BAD('fb')} THEN 'Chung' ELSE fb END) as category, list_reduce(list_prepend(f1, {S.codes('f1')}), lambda u, v: regexp_replace(u, '(?i)' || regexp_escape(v), ' ', 'g')) as f2,
  CASE WHEN code <> '' THEN code ELSE {_best(S.joined(_ITEM, 'specs'))} END as m0 from l),
n as (select *, trim(regexp_replace(regexp_replace(regexp_replace(f2, '\\s*[,;|]\\s*', '/', 'g'), '/{{2,}}', '/', 'g'), '^/+|/+$', '', 'g')) as feature, {_model('m0')} as model from m),
o as (select *, list_filter(list_transform(string_split(feature, '/'), lambda v: trim(v)), lambda v: v <> '') as fparts, {_kind(S.joined('specs', 'feature'), 'code', 'category')} as fkind, {_kind('specs', "CASE WHEN model <> '' THEN model ELSE code END", 'category')} as mkind from n),
q as (select *, CASE WHEN length(feature) < 4 or {_COLOUR('feature')} THEN '' WHEN len(fparts) <= 3 THEN substr(feature, 1, 50) ELSE fparts[1] || '/' || fparts[2] || '/' || fparts[3] || '...' END as short from o),
r as (select *, {S.flat(f"CASE WHEN length(code) >= 4 THEN {S.joined('fkind', _BRANDED('code'), 'code')} ELSE array_to_string(list_filter([fkind, brand, short], lambda v: v <> ''), ' - ') END")} as by_feature,
  CASE WHEN model = '' THEN {_ITEM} ELSE {S.flat(S.joined('mkind', _BRANDED('model'), 'model'))} END as by_model from q),
s as (select * replace (CASE WHEN (item = '' or from_feature) and len(feature_cols) + len(name_source_cols) > 0 and length(by_feature) >= 6 THEN by_feature
  WHEN (from_sku or (code <> '' and ({_ITEM} = '' or {_ITEM} = {S.flat('code')} or {_COLOUR('item')} or {S.hit(_ITEM, N.SPEC_ONLY)} or {S.hit(_ITEM, N.DIMENSIONS)} or length({_ITEM}) > 115))) and by_model <> '' THEN by_model ELSE item END as item) from r),
u as (select * replace (CASE WHEN item = '' and specs <> '' and code = '' THEN substr(specs, 1, 60) WHEN length(item) between 1 and 5 and code <> '' THEN by_model ELSE item END as item) from s)
select sheet, idx, item as name, code as sku, category, coalesce(nullif(sup, ''), nullif(brand, ''), file_supplier) as supplier, coalesce(nullif(unit, ''), 'Cái') as unit, cost, listed, least, CASE WHEN listed > 0 THEN 'fixed' ELSE 'markup' END as price_mode,
  specs, current, old, current > 0 and coalesce(cost = tier, false) as used_tier, code = '' and length({S.flat('specs')}) < 4 and {_GENERIC} as subtotal
from u where length(item) >= 2 and not (code = '' and {S.hit(_ITEM, I.NAMELESS)})""",
}

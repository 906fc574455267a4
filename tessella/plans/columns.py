"""Column mapping of sheets in a dozen layouts, filled from the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import columns as M
from tessella.plans import sql as S
from tessella.plans.quoting import table

# Cells that both dialects read alike.
_CODE, _NAME, _COST, _LESS = "concat('LM-', p_size, 'S', p_partkey)", "concat('Widget ', p_name)", "concat('', p_size * 100000 + 50000)", "concat('', p_size * 1000)"
_SPEC, _COLOUR, _UNIT, _NONE = "concat('Chất liệu hợp kim, Công suất ', p_size, 'W')", S.pick("p_size", ["đen", "trắng/xám", "Vàng"]), S.pick("p_size", ["bộ", "cái"]), "''"
_LONG = f"concat({_SPEC}, ' - ', repeat('mô tả chi tiết ', 8))"
# Sheets: headers, and what the cells below hold; the third and the eleventh have no header that says anything.
LAYOUTS = [
    [("STT", "concat('', p_partkey)"), ("Mã sản phẩm", _CODE), ("Tên sản phẩm", _NAME), ("Thông số kỹ thuật", _SPEC), ("ĐVT", _UNIT), ("GIÁ NHẬP", _COST)],
    [("Mã hàng", _CODE), ("Thông số kỹ thuật", _SPEC), ("Màu sắc", _COLOUR), ("Giá đại lý", _COST)],
    [("", _CODE), ("x", _NAME), ("", _LESS), ("", _COST), ("y", _UNIT)],
    [("Model", _CODE), ("Tên thiết bị", _NAME), ("Giá bán lẻ công bố", _COST), ("Giá bán cho đại lý", _LESS), ("Đơn giá", _COST)],
    [("Hình ảnh", _CODE), ("Tính năng", _SPEC), ("Quy cách", _LONG), ("Giá gốc chưa bao gồm VAT tính thưởng", _COST), ("Thành tiền", _COST)],
    [("Mã SP", _CODE), ("Tên hàng", _LONG), ("Dòng", _NAME), ("Giá", _COST)],
    [("Hãng sản phẩm", _NAME), ("Chức năng", _SPEC), ("Code", _CODE), ("Price", _COST)],
    [("Hãng sản phẩm", _NAME), ("SKU", _CODE), ("Loại", _UNIT), ("Giá sỉ", _LESS)],
    [("SKU", _CODE), ("Tên gọi", _NAME), ("Từ 10 bộ", _LESS), ("Trên 50", _LESS), ("Điều chỉnh tăng 15/04/2026", _COST), ("Giá niêm yết", _COST)],
    [("Danh mục", _UNIT), ("NCC", "p_brand"), ("Tên gọi", _COLOUR), ("Part No", _CODE), ("Giá NPP", _COST)],
    [(None, _CODE), (None, _NAME), (None, _COST)],
    [("Số lượng", _LESS), ("Bảo hành", _UNIT), ("Ghi chú", _NONE)],
    [("Đại lý bán lẻ thấp nhất", _COST), ("Vật tư", _LONG), ("Giá mới", _COST), ("Giá vốn", _LESS), ("Mã", _CODE), ("Xuất xứ", _UNIT)],
]
SHEET = f"p_partkey % {len(LAYOUTS)}"


def _text(open_: str, close: str) -> str:
    return f"CASE {SHEET} " + " ".join(f"WHEN {i} THEN {open_}{', '.join(x for _, x in cells)}{close}" for i, cells in enumerate(LAYOUTS)) + " END"


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "part").selectExpr(f"{SHEET} as sheet", "p_partkey as idx", f"{_text('array(', ')')} as text")
    headers = spark.createDataFrame([(i, [label for label, _ in cells]) for i, cells in enumerate(LAYOUTS) if cells[0][0] is not None], "sheet long, text array<string>")
    return headers, rows


def column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.map_columns(*_sheets(spark, sf_dir))


def first_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cell_stats(_sheets(spark, sf_dir)[1])


_X = "x"
_ODD = f"({S.hit(_X, M.COLOUR)} or {S.hit(_X, M.SPECS)} or {S.hit(_X, M.MEASURE)} or regexp_matches(x, '{M.NUMBER}'))"
_STATS = f"""raw as (select {SHEET} as sheet, p_partkey as idx, {_text('[', ']')} as t from part),
top as (select *, row_number() over (partition by sheet order by idx) as r from raw qualify r <= 12),
d as (select sheet, r, unnest(range(len(t))) as col, trim(unnest(t)) as x from top),
f as (select *, length(x) as l, regexp_matches(x, '{M.NUMBER}') and regexp_matches(x, '[0-9]') as num, regexp_matches(x, '(?i){M.CODE}') and regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]') as cod,
  {S.hit(_X, M.SPECS)} as spec, {_ODD} as odd, try_cast(regexp_replace(x, '[^0-9]', '', 'g') as double) as v from d where x <> ''),
stats as (select sheet, CAST(col AS INTEGER) as col, count(*) as n, avg(num::INT) as numeric, avg((cod and not num)::INT) as code, avg((not num and not cod and l > 15)::INT) as long, avg(l) as len, avg((spec or l > 120)::INT) as specish,
  avg((odd or l > 115)::INT) >= 0.35 or avg((l between 6 and 85 and not odd)::INT) < 0.3 as bad, avg(num::INT) filter (r <= 8) as early_numeric, avg((cod and not num)::INT) filter (r <= 8) as early_code,
  avg(v) filter (r <= 8 and v >= 100) as money from f group by 1, 2)"""
_HEADS = ", ".join(f"({i}, [{', '.join(S.quoted(label) for label, _ in cells)}])" for i, cells in enumerate(LAYOUTS) if cells[0][0] is not None)
_FLAGS = [(f"is_{f}", p) for f, p in [*M.FIELDS, *M.ROLES, ("cost", M.COST), ("price", M.PRICE)]] + [("no_name", M.NO_NAME)]
_POINTS = " + ".join(f"CASE WHEN {S.hit('label', p)} THEN {v}::DOUBLE ELSE 0 END" for v, p in M.PRICE_POINTS)
_IN = lambda *names: f"coalesce(c.col in ({', '.join(names)}), false)" if names else "false"
_FIELDS = "".join(
    f"s{i + 1} as (select *, list_filter(cols, lambda c: c.is_{f} and not {_IN(*M.FOUND[:i])})[1].col as {f} from s{i}),\n" for i, f in enumerate(M.FOUND)
)
_ROLES = ", ".join(
    f"list_transform(list_filter(cols, lambda c: c.is_{r} and not {_IN(*(('current_price', 'list_price', 'sku', 'name') if r == 'tier' else ()))}), lambda c: c.col) as {r}_cols" for r, _ in M.ROLES
)
_TAKEN = _IN(*M.FOUND, "price")
_TOP = lambda test, score: f"list_sort(list_transform(list_filter(cols, lambda c: {test}), lambda c: {{'s': -({score}), 'col': c.col}}))[1]"
_FREE = f"not {_TAKEN} and not list_contains(tier_cols, c.col)"
_TEXTUAL = "c.n >= 3 and c.numeric <= 0.35 and c.code <= {0}"

QUERIES = {f.__name__: f for f in (column_map, first_cells)}
ORACLES = {
    "first_cells": f"with {_STATS} select * from stats",
    "column_map": f"""with {_STATS}, heads(sheet, t) as (values {_HEADS}), h as (select sheet, CAST(unnest(range(len(t))) AS INTEGER) as col, trim(unnest(t)) as label from heads),
marked as (select *, {', '.join(f"label <> '' and {S.hit('label', p)} as {n}" for n, p in _FLAGS)}, {_POINTS} as points from h),
both_ as (select coalesce(s.sheet, m.sheet) as sheet, coalesce(s.col, m.col) as col, coalesce(label, '') as label, {', '.join(f'coalesce({n}, false) as {n}' for n, _ in _FLAGS)}, coalesce(points, 0) as points,
  {', '.join(f'coalesce({s}, 0) as {s}' for s in M.STATS)}, coalesce(bad, true) as bad from stats s full join marked m on s.sheet = m.sheet and s.col = m.col),
s0 as (select sheet, list(b order by col) as cols from both_ b group by 1),
{_FIELDS}r as (select *, {_ROLES}, nullif(regexp_extract(list_filter(cols, lambda c: {_IN('current_price')})[1].label, {S.quoted(M.DATE)}, 1), '') as price_date,
  list_filter(cols, lambda c: c.is_cost and not {_IN(*M.FOUND)})[1] as a, list_filter(cols, lambda c: c.is_price and not {_IN(*M.FOUND)})[1] as b from s{len(M.FOUND)}),
p as (select *, a is null or coalesce(b.points + 1 > a.points + 2, false) as later from r),
q as (select * replace (coalesce(name, CASE WHEN g.s < -20 THEN g.col END) as name) from (select *, CASE WHEN later THEN b.col ELSE a.col END as price, CASE WHEN later THEN a.col ELSE b.col END as other_price,
  len(feature_cols) + len(name_source_cols) > 0 as hinted, {_TOP(f"not {_IN(*M.FOUND, 'CASE WHEN later THEN b.col ELSE a.col END')} and not c.no_name and {_TEXTUAL.format(0.55)} and c.specish <= 0.25 and not c.bad", '80 - abs(c.len - 28) + c.long * 5')} as g from p)),
k as (select * replace (coalesce(sku, {_TOP(_FREE + ' and c.early_code > 0.3', 'c.early_code')}.col) as sku) from q),
m as (select * replace (coalesce(price, {_TOP(_FREE + ' and c.early_numeric >= 0.5 and c.money > 0', 'c.money')}.col) as price) from k),
w as (select *, list_filter(cols, lambda c: {_IN('name')})[1] as was, {_TOP(f"not {_IN('name', 'price', 'list_price', 'least_price', 'unit', 'sku', 'category', 'supplier')} and {_TEXTUAL.format(0.6)} and c.len between 4 and 95 and c.specish <= 0.35", '100 - abs(c.len - 28) - c.specish * 50 + c.long * 8')}.col as better from m),
e as (select *, CASE WHEN name is null THEN 'none' WHEN was.no_name THEN 'no_name' WHEN (was.specish >= 0.45 or was.len > 110) and better is not null THEN 'swap' WHEN was.specish >= 0.45 or was.len > 110 THEN CASE WHEN sku is null THEN 'kept' ELSE 'specs' END
  WHEN was.bad and sku is not null THEN 'bad' ELSE 'kept' END as how from w),
z as (select sheet, sku, CASE how WHEN 'swap' THEN better WHEN 'kept' THEN name END as name, CASE WHEN how in ('swap', 'specs') THEN coalesce(specs, name) ELSE specs END as specs, {', '.join(M.FOUND[3:])}, price, other_price,
  {', '.join(f'{r}_cols' for r, _ in M.ROLES)}, price_date, how in ('none', 'no_name') and hinted as from_feature,
  sku is not null and (how in ('none', 'specs', 'bad') or (how = 'no_name' and not hinted)) as from_sku, how = 'swap' as name_was_specs from e)
select *, least(1e0, round(CASE WHEN name is not null THEN 0.4::DOUBLE WHEN from_feature THEN 0.24 WHEN from_sku THEN 0.18 ELSE 0 END + {' + '.join(f'CASE WHEN {c} is not null THEN {v}::DOUBLE ELSE 0 END' for c, v in (('price', 0.28), ('list_price', 0.07), ('current_price', 0.09), ('sku', 0.2), ('unit', 0.05), ('specs', 0.05)))}, 6)) as confidence from z""",
}

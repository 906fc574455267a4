"""Previews of the catalogue's files: plain sheets, engines in turn, canonical lines, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import preview as V
from tessella.plans import sql as S
from tessella.plans.quoting import table

# Sheets of a file: title, headers of three kinds, then rows of the catalogue; every second kind has no name header.
HEADS = [["STT", "Mã SP", "Tên hàng", "Đơn giá", "Hãng"], ["Model", "x", "Thông số kỹ thuật", "Giá", "Nhóm"], ["Sản phẩm", "Code", "ĐVT", "Giá nhập", "Loại"]]
KIND, FILE = "p_size % 3", "concat(p_brand, '_list-2024.xlsx')"
_NUMBER = "CASE WHEN p_size % 7 = 0 THEN 'liên hệ' ELSE concat('', p_size * 1000, '.000 đ') END"
_CELLS = [["concat('', p_partkey)", "concat('LM-', p_partkey)", "p_name", _NUMBER, "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END"], ["concat('D', p_partkey)", "concat(p_name, ' ', p_type)", "p_type", _NUMBER, "''"], ["CASE WHEN p_size % 10 = 2 THEN 'x' ELSE p_name END", "''", "'bộ'", _NUMBER, "p_type"]]


def _text(open_: str, close: str) -> str:
    return f"CASE {KIND} " + " ".join(f"WHEN {i} THEN {open_}{', '.join(c)}{close}" for i, c in enumerate(_CELLS)) + " END"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "part").selectExpr(f"{FILE} as file", f"concat('S', {KIND}) as sheet", "p_partkey + 10 as idx", f"{_text('array(', ')')} as text")
    heads = spark.createDataFrame([(f"S{i}", 2, h) for i, h in enumerate(HEADS)] + [(f"S{i}", 1, ["Báo giá", None, "", "", "2024"]) for i in range(3)], "sheet string, idx long, text array<string>")
    return body.unionByName(body.select("file", "sheet").distinct().join(heads, "sheet").select("file", "sheet", "idx", "text"))


def plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.plain_items(_rows(spark, sf_dir))


_STATUS = S.pick("row", ["new", "matched", "review", "rejected", "skipped", "new", "matched"])
_SURE = "(row % 97) / 90.0D"
_OWN = "contains(file, '1') or contains(file, '3')"


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plain = plain_items(spark, sf_dir).withColumn("row", F.col("idx")).withColumn("cost", F.col("price"))
    both = lambda df, status, sure: df.selectExpr(
        "file", "sheet", "row", "name", "sku", "category", "supplier", "unit", "cost", "CASE WHEN row % 5 = 0 THEN cost * 2 ELSE 0D END as listed", "0D as least", "'markup' as price_mode", "specs", "raw",
        "CASE WHEN row % 3 = 0 THEN row END as product", "'name' as match_type", "0.9D as match_score", f"{sure} as confidence", f"{status} as status",
        "CASE WHEN cost = 0 THEN array(named_struct('code', 'missing_price', 'level', 'error')) ELSE cast(array() as array<struct<code:string,level:string>>) END as issues", "row % 7 = 4 as subtotal",
    )
    names = table(spark, sf_dir, "part").selectExpr(f"{FILE} as file").distinct().unionByName(table(spark, sf_dir, "nation").selectExpr("concat(n_name, '.pdf') as file"))
    items, files = V.cascade(names, both(plain.where(_OWN), _STATUS, _SURE), both(plain, "'new'", "0.66D"))
    return V.import_lines(items), files


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)[0]
    return lines.select("file", "line_no", "status", "confidence", "source.sheet", F.col("raw.name").alias("raw"), "parsed.name", "parsed.price_mode", "parsed.skip_reason", F.col("matched.product").alias("product"), F.size("issues").cast("long").alias("n_issues"))


def import_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.previews(*_lines(spark, sf_dir))


def importable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.importable(_lines(spark, sf_dir)[0]).drop("line_id")


# What the headers above mean: name, code, category, supplier, unit, price and specifications by kind of sheet.
_BY = lambda *xs: f"CASE {KIND} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
_NAMED = "left(replace(replace(p_brand || '_list-2024', '_', ' '), '-', ' '), 25)"
_PLAIN = f"""plain as (select {FILE} as file, concat('S', {KIND}) as sheet, p_partkey + 10 as idx, {_BY('p_name', "p_name || ' ' || p_type", "CASE WHEN p_size % 10 = 2 THEN 'x' ELSE p_name END")} as name,
  {_BY("'LM-' || p_partkey", "'D' || p_partkey", "''")} as sku, {_BY("'Chung'", "'Chung'", 'p_type')} as category, CASE WHEN {KIND} = 0 and p_size % 2 = 0 THEN p_brand ELSE {_NAMED} END as supplier,
  {_BY("'Cái'", "'Cái'", "'bộ'")} as unit, CASE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE ELSE p_size * 1000000.0::DOUBLE END as price, {_BY("''", 'p_type', "''")} as specs, array_to_string(list_filter({_text('[', ']')}, lambda k: k <> ''), ' ') as raw
  from part where {KIND} <> 2 or p_size % 10 <> 2)"""
_SQL = f"""{_PLAIN}, own as (select * from plain where {_OWN}), files as (select distinct {FILE} as file from part union all select n_name || '.pdf' from nation),
picked as (select *, idx as row, {_STATUS.replace('row', 'idx')} as st, (idx % 97) / 90.0::DOUBLE as sure from own union all select *, idx, 'new', 0.66::DOUBLE from plain where file not in (select file from own)),
lines as (select *, row_number() over (partition by file order by sheet, row) as line_no, greatest(0.0, least(1.0, sure)) as c, CASE WHEN row % 3 = 0 THEN row END as product, CASE WHEN row % 5 = 0 THEN price * 2 ELSE 0 END as listed,
  CASE WHEN st in ('rejected', 'failed') THEN 'failed' WHEN st = 'skipped' THEN 'skipped' WHEN st = 'review' THEN 'need_review' WHEN price = 0 and sure < 0.7 THEN 'failed' WHEN sure < 0.62 THEN 'need_review' ELSE 'auto_approved' END as status from picked),
l as (select *, CASE WHEN listed > 0 THEN 'fixed' ELSE 'markup' END as price_mode, floor(c * 100 + 0.5) / 100 as confidence from lines)"""

QUERIES = {f.__name__: f for f in (plain_items, import_lines, import_previews, importable_lines)}
ORACLES = {
    "plain_items": f"with {_PLAIN} select * from plain",
    "import_lines": f"with {_SQL} select file, line_no, status, confidence, sheet, raw, name, price_mode, CASE WHEN row % 7 = 4 THEN 'generic_category_subtotal' END as skip_reason, product, CASE WHEN price = 0 THEN 1 ELSE 0 END::BIGINT as n_issues from l",
    "import_previews": f"""with {_SQL}, n as (select file, count(*) as total_rows, count(*) filter (status <> 'skipped') as parsed_items, {', '.join(f"count(*) filter (status = '{s}') as {s}" for s in V.STATUSES)}, count(product) as matched,
  count(*) filter (product is null and status not in ('failed', 'skipped')) as new, avg(round(confidence * 100)) filter (status <> 'skipped') as m from l group by 1)
select f.file, CASE WHEN n.file is not null and f.file not in (select file from own) THEN 'legacy' ELSE 'v2' END as engine, CASE WHEN n.file is null THEN '{V.EMPTY}' WHEN f.file in (select file from own) THEN '' ELSE '{V.LEGACY}' END as warning,
  {', '.join(f'coalesce({c}, 0) as {c}' for c in ('total_rows', 'parsed_items', *V.STATUSES, 'matched', 'new'))}, floor(coalesce(m, 0) + 0.5) / 100 as confidence from files f left join n on f.file = n.file""",
    "importable_lines": f"with {_SQL} select file, name, sku, category, supplier, unit, price as cost, listed, 0.0::DOUBLE as least, price_mode, specs, status, confidence, product from l where status not in ('failed', 'skipped')",
}

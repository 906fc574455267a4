"""Queries over bills of materials: headers, areas, disciplines, lines, scopes, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import bom as B
from tessella.plans import sql as S
from tessella.plans.quoting import spread, table

LINES = [
    "1. Công tắc thông minh LM-S4 SL: 2", "Đèn downlight LM-D12-75", "Camera DS-2CD2143G2 4MP", "PHÒNG KHÁCH", "Tổng cộng", "Cáp mạng cat6", "Thiết bị", "Điều hòa cassette FXFQ50A", "Khóa vân tay DDL702",
    "Router wifi mesh RG-EW1200", "Cảm biến hiện diện", "Rèm động cơ 20NM", "Loa âm trần", "TẦNG 2", "LM-S4", "Vật tư phụ khác không rõ", "ab", "ống hdpe D20", "Nhân công lắp đặt", "Chuông hình camera chuông BAS-IP",
]
SHEETS = ["Điện thông minh", "Chiếu sáng", "Điều hòa HVAC", "Bảng 1", "Hạ tầng cáp", "Camera an ninh", "Khác"]
QTYS = ["2", "", "1,5", "0", "12 bộ", "05/06/2024", "8"]
CELLS = {"name": S.pick("p_partkey", LINES), "model": S.pick("p_size", ["", "Model", "Mã SP", "x"]), "qty": S.pick("p_size + p_partkey", ["", "Số lượng", "SL", "3", "ĐVT"]), "unit": S.pick("p_partkey", ["", "ĐVT", "bộ"])}
LINE, SHEET, QTY = CELLS["name"], S.pick("p_size", SHEETS), S.pick("p_partkey + p_size", QTYS)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey as id", f"{SHEET} as sheet", f"{LINE} as text", f"{QTY} as q", "p_brand as area", "p_name")
    rows = rows.withColumn("model", B.model_of(F.col("text")))
    rows = rows.withColumns({"name": B.bare_name(F.col("text"), F.col("model")), "qty": F.regexp_extract(F.replace(F.col("q"), F.lit(","), F.lit(".")), r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")})
    rows = rows.withColumn("qty", F.when(F.col("q").contains("/"), None).otherwise(F.col("qty")))
    family = B.family_of(B.plain(F.concat_ws(" ", "sheet", "name", "model")), F.when(F.col("sheet") == "Chiếu sáng", "lighting").when(F.col("sheet") == "Điện thông minh", "smart_home").otherwise(""))
    return rows.withColumns({"category": B.category_of(F.concat_ws(" ", "name", "model")), "f": family, "s": B.line_status(F.col("name"), F.col("qty"), F.col("model"))})


def bom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("id", "name", "model", "qty", "category", "f.family", "f.confidence", "f.supporting", "s.status", F.col("s.n_issues").cast("int").alias("n_issues"), B.product_like(F.col("name")).alias("product_like"), B.numeric_like(F.col("q")).alias("numeric"))


def bom_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes with their place: supporting ones last, then by number of lines."""
    lines = _lines(spark, sf_dir).select(B.scope_id(F.col("f.family")).alias("scope"), "f.supporting", "qty", "area", "s.status", "id")
    scopes = lines.groupBy("scope").agg(
        F.max("supporting").alias("supporting"), F.count("*").alias("n_lines"), F.sum(F.coalesce("qty", F.lit(0.0))).alias("qty"), F.count_if(F.col("status") == "ready").alias("n_ready"), F.countDistinct("area").alias("n_areas"), F.min("id").alias("first_id")
    )
    place = F.row_number().over(Window.orderBy("supporting", F.desc("n_lines"), "first_id"))  # a scope is one of a dozen families
    return scopes.withColumn("place", place)


def bom_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("f.family", "f.supporting", "area", "s.status", (F.col("model") != "").alias("matched"))
    n = lines.agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "need_review").alias("review"), F.count_if("matched").alias("matched"),
        F.countDistinct("area").alias("n_areas"), F.countDistinct("family").alias("families"), F.countDistinct(F.when(~F.col("supporting"), F.col("family"))).alias("n_scopes"),
    )
    share = (F.col("ready") * 0.65 + F.col("matched") * 0.2 + F.least("families", F.lit(8)) * 0.015 * F.col("n_lines")) / F.col("n_lines") * 100
    return n.withColumn("confidence", F.when(F.col("n_lines") > 0, F.floor(share + 0.5)).otherwise(0).cast("long")).drop("families")


def bom_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of each sheet: the first of the best among its first 35 rows, with eight points or more."""
    rows = table(spark, sf_dir, "part").selectExpr(f"{SHEET} as sheet", "p_partkey as id", f"array({', '.join(CELLS.values())}) as text")
    top = rows.withColumn("idx", F.row_number().over(Window.partitionBy("sheet").orderBy("id"))).where("idx <= 35")
    scored = top.select("sheet", "idx", B.header_score(F.col("text")).alias("score")).where("score >= 8")
    return scored.groupBy("sheet").agg(F.max(F.struct("score", (-F.col("idx")).alias("early"))).alias("b")).select("sheet", (-F.col("b.early")).cast("int").alias("header_row"), F.col("b.score").cast("int").alias("score"))


def bom_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the area of the last area row above it in its sheet."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as sheet", "p_partkey as id", f"array({LINE}, {QTY}) as text").withColumn("label", B.area_of(F.col("text")))
    above = Window.partitionBy("sheet").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("sheet", "id", F.coalesce(F.last("label", ignorenulls=True).over(above), F.lit("Chưa phân khu")).alias("area"))


def bom_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discipline of each sheet from its name, its first four rows and its first 45 rows, and its number of rows."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as brand", f"concat(p_brand, ' ', {SHEET}) as sheet", "p_partkey as id", f"{LINE} as text")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("sheet").orderBy("id")))
    first = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") <= n, F.struct("idx", "text")))), lambda s: s["text"]), " ")
    sheets = rows.groupBy("sheet").agg(F.count("*").alias("n_rows"), first(4).alias("title"), first(45).alias("body"))
    found = B.discipline_of(B.plain(F.concat_ws(" ", "sheet", "title")), B.plain(F.concat_ws(" ", "sheet", "body")))
    return sheets.select("sheet", "n_rows", found.alias("d")).select("sheet", "n_rows", "d.*")


_any = lambda x, words: "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"
_BARE = r"trim(regexp_replace(regexp_replace(" + S.flat("text") + r", '^[0-9]+[.)]\s*', ''), '(?i)\b(SL|QTY|DVT|ĐVT)\b\s*[:：]?\s*[0-9]*\s*', '', 'g'))"
_LIKE = f"(length(n) >= 4 and not {_any('n', B.NO_PRODUCT)} and n not in ({', '.join(map(S.quoted, B.EMPTY_NAMES))}) and ({_any('n', B.TECHNICAL)} or (len(string_split(n, ' ')) >= 2 and length(n) >= 8)))"


def _points(text: str, d: str, family: str, words: list[str]) -> str:
    bonus = "".join(f" + CASE WHEN {d} = '{k}' THEN {v} ELSE 0 END" for (k, f), v in B.BONUS.items() if f == family)
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN {4 if len(w) >= 8 else 2} ELSE 0 END" for w in words) + bonus


_FAMILY = "[" + ", ".join(f"{{'score': {_points('ft', 'd', f, words)}, 'early': {-k}, 'name': '{f}'}}" for k, (f, words) in enumerate(B.FAMILIES.items())) + "]"
_BASE = f"""b as (select p_partkey as id, {SHEET} as sheet, {LINE} as text, {QTY} as q, p_brand as area from part),
m as (select *, list_filter(list_concat({', '.join(f"regexp_extract_all({S.flat('text')}, {S.quoted(p)})" for p in B.MODELS)}), lambda v: v not in ({', '.join(map(S.quoted, B.NO_MODELS))})) as ms, {_BARE} as s from b),
o as (select *, coalesce(list_filter(ms, lambda v: length(v) = list_max(list_transform(ms, lambda w: length(w))))[1], '') as model from m),
e as (select *, CASE WHEN model = '' THEN s WHEN upper(s) = upper(model) THEN '' ELSE trim(regexp_replace(regexp_replace(s, '(?i)\\b' || model || '\\b', ''), '[-–—|]+$', '')) END as name,
  CASE WHEN contains(q, '/') THEN NULL ELSE TRY_CAST(nullif(regexp_extract(replace(q, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) END as qty from o),
g as (select *, {S.plain('name')} as n, {S.plain("name || ' ' || model")} as nm, {S.plain("sheet || ' ' || name || ' ' || model")} as ft, CASE sheet WHEN 'Chiếu sáng' THEN 'lighting' WHEN 'Điện thông minh' THEN 'smart_home' ELSE '' END as d from e),
h as (select *, coalesce({S.first_of('nm', B.CATEGORIES)}, 'Khác') as category, {_LIKE} as product_like, list_max({_FAMILY}) as best from g),
l as (select *, CASE WHEN best.score > 0 THEN best.name ELSE 'other' END as family, CASE WHEN best.score >= 5 THEN 'high' WHEN best.score >= 3 THEN 'medium' ELSE 'low' END as confidence, best.score > 0 and best.name = '{B.SUPPORTING}' as supporting,
  CAST((name = '' or not product_like)::INT + (coalesce(qty, 0) <= 0)::INT + (model = '')::INT + (length(name) > 130)::INT AS INTEGER) as n_issues from h),
z as (select *, CASE WHEN n_issues = 0 or (n_issues = 1 and model = '') THEN 'ready' ELSE 'need_review' END as status from l)"""
_HAS = {f: f"len(list_filter(list_transform(t, lambda c: {S.plain('c')}), lambda c: regexp_matches(c, '{'|'.join(w)}'))) > 0" for f, w in B.HEADER_HINTS.items()}
_AREA = rf"""CASE WHEN len(fl) between 1 and 3 and w <> '' and not {_any('w', B.NO_PRODUCT)} and ({_any('w', B.AREA_WORDS)} or (length(fl[1]) >= 4 and fl[1] = upper(fl[1])) or ({_any('w', B.TECHNICAL)} and length(fl[1]) < 60))
  THEN regexp_replace(coalesce(list_filter(fl, lambda c: not regexp_matches(c, '(?i)^(?:[IVXLCDM]+|[0-9]+)$'))[1], fl[1]), '^[0-9]+[.)]\s*', '') END"""
_DISCIPLINE = "[" + ", ".join(
    "{'score': " + " + ".join(f"CASE WHEN contains(tt, '{w}') THEN {8.0 if len(w) > 8 else 5.0} WHEN contains(bt, '{w}') THEN {3.0 if len(w) > 8 else 1.5} ELSE 0.0 END::DOUBLE" for w in words) + f", 'early': {-k}, 'name': '{d}'}}" for k, (d, words) in enumerate(B.DISCIPLINES.items())
) + "]"

QUERIES = {f.__name__: f for f in (bom_lines, bom_scopes, bom_totals, bom_headers, bom_areas, bom_sheets)}
ORACLES = {
    "bom_lines": f"with {_BASE} select id, name, model, qty, category, family, confidence, supporting, status, n_issues, product_like, regexp_matches(regexp_replace(coalesce(q, ''), '[,.\\s]', '', 'g'), '^-?[0-9]+$') as numeric from z",
    "bom_scopes": f"""with {_BASE}, s as (select 'scope_' || family as scope, max(supporting) as supporting, count(*) as n_lines, sum(coalesce(qty, 0)) as qty, count(*) filter (status = 'ready') as n_ready, count(distinct area) as n_areas, min(id) as first_id from z group by 1)
select *, CAST(row_number() over (order by supporting, n_lines desc, first_id) AS INTEGER) as place from s""",
    "bom_totals": f"""with {_BASE}, s as (select count(*) as n_lines, count(*) filter (status = 'ready') as ready, count(*) filter (status <> 'ready') as review, count(*) filter (model <> '') as matched, count(distinct area) as n_areas,
  count(distinct family) as f, count(distinct family) filter (not supporting) as n_scopes from z)
select n_lines, ready, review, matched, n_areas, n_scopes, CAST(floor((ready * 0.65::DOUBLE + matched * 0.2::DOUBLE + least(f, 8) * 0.015::DOUBLE * n_lines) / n_lines * 100 + 0.5) AS BIGINT) as confidence from s""",
    "bom_headers": f"""with r as (select {SHEET} as sheet, [{', '.join(CELLS.values())}] as t, row_number() over (partition by {SHEET} order by p_partkey) as idx from part),
p as (select sheet, idx, {' + '.join(f"CASE WHEN {h} THEN {4 if f in ('name', 'qty') else 2} ELSE 0 END" for f, h in _HAS.items())} + CASE WHEN {_HAS['name']} and {_HAS['qty']} THEN 6 ELSE 0 END + CASE WHEN {_HAS['unit']} THEN 2 ELSE 0 END as score from r where idx <= 35)
select sheet, CAST(idx AS INTEGER) as header_row, CAST(score AS INTEGER) as score from p where score >= 8 qualify row_number() over (partition by sheet order by score desc, idx) = 1""",
    "bom_areas": f"""with r as (select p_brand as sheet, p_partkey as id, list_filter([{S.flat(LINE)}, {S.flat(QTY)}], lambda c: c <> '') as fl from part), w as (select *, {S.plain("array_to_string(fl, ' ')")} as w from r), a as (select *, {_AREA} as label from w)
select sheet, id, coalesce(last_value(label ignore nulls) over (partition by sheet order by id rows between unbounded preceding and current row), 'Chưa phân khu') as area from a""",
    "bom_sheets": f"""with r as (select p_brand || ' ' || {SHEET} as sheet, p_partkey as id, {LINE} as text from part), x as (select *, row_number() over (partition by sheet order by id) as idx from r),
s as (select sheet, count(*) as n_rows, {S.plain("sheet || ' ' || string_agg(text, ' ' order by idx) filter (idx <= 4)")} as tt, {S.plain("sheet || ' ' || string_agg(text, ' ' order by idx) filter (idx <= 45)")} as bt from x group by sheet),
b as (select *, list_max({_DISCIPLINE}) as best, CASE {' '.join(f"WHEN regexp_matches(tt, '{p}') THEN '{d}'" for d, p in B.TITLES)} END as named from s),
k as (select *, coalesce(named, CASE WHEN best.score > 0 THEN best.name ELSE 'unknown' END) as key, CASE WHEN named is not null THEN greatest(best.score, 20.0::DOUBLE) ELSE best.score END as sc from b),
f as (select *, sc < 4 and regexp_matches(bt, '{B.LIST_WORDS}') as listed from k)
select sheet, n_rows, CASE WHEN listed and key = 'unknown' THEN 'generic_bom' ELSE key END as discipline, CASE WHEN listed THEN greatest(sc, 3.0::DOUBLE) ELSE sc END as score, sc >= 4 or listed as included from f""",
}

"""Queries over page text of price lists and over packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import pdf as D
from tessella.functions import products as P
from tessella.operators import packs as K
from tessella.operators.packs import Component, Option
from tessella.plans import sql as S
from tessella.plans.quoting import table

LINES = [
    "Cổng âm sàn VULCAN 24V 41.900.000 19.765.000", "Thời gian giao hàng 03-05 ngày", "CÔNG TẮC LUMI", "1. DE Công tắc gắn tường Door Exit DE-01 220.000 700.000 đ", "Mã hàng Tên", "LM-ST7-55-O Đèn downlight công suất 7W 648.000đ",
    "Bảng giá đèn", "Tổng cộng 12.000.000", "20KZ500 loa bộ 1.250.000", "ab", "Khóa vân tay giá lẻ 5.000.000 giá npp 4.100.000", "", "Camera IPC200 90.000 kích thước 10x20", "Vít nở 5.000",
]
LINE = S.pick("p_partkey", LINES)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_brand as file", "p_size as page", "p_partkey as line_no", f"{LINE} as line")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows of page text with the section above them, in the order of pages and lines of a file."""
    rows = _pages(spark, sf_dir).withColumn("heads", D.section(F.col("line")))
    above = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.substring(F.regexp_replace(F.col("line"), r"(?iu)^bảng giá\s*", ""), 1, 90)
    rows = rows.withColumn("category", F.coalesce(F.last(F.when(F.col("heads") & (title != ""), title), ignorenulls=True).over(above), F.lit("Chung")))
    rows = rows.withColumns({"v": P.money_values(F.col("line")), "sku": D.code(F.col("line"))}).where(~F.col("heads") & ~D.skipped(F.col("line")) & (F.size("v") > 0))
    rows = rows.withColumn("name", D.name(F.col("line"), F.col("sku")))
    rows = rows.withColumn("name", F.when((F.length("name") < 3) & (F.col("sku") != ""), F.concat_ws(" ", "category", "sku")).otherwise(F.col("name"))).where("length(name) >= 3")
    return rows.select("file", "page", "line_no", "name", "sku", "category", D.unit(F.col("line")).alias("unit"), P.price_fields(F.col("v")).alias("p"), D.specs(F.col("line")).alias("specs")).select("file", "page", "line_no", "name", "sku", "category", "unit", "p.*", "specs")


# Components of three templates and options of three scopes; others are given the same way.
COMPONENTS = [
    Component("door_phone", "door_station", True, True, ["chuong", "door", "station", "camera chuong", "nut chuong", "intercom"]),
    Component("door_phone", "indoor_monitor", True, True, ["man hinh", "monitor", "indoor", "chuong hinh", "intercom"]),
    Component("door_phone", "power_network", False, False, ["poe", "switch", "nguon", "adapter", "power"]),
    Component("smart_lighting", "fixture", True, False, ["den", "downlight", "spotlight", "led", "lighting", "ray"]),
    Component("smart_lighting", "driver", False, False, ["driver", "nguon", "adapter", "24v", "48v"]),
    Component("smart_lighting", "dimmer_controller", False, True, ["dimmer", "controller", "tun", "tunable", "dieu khien", "lighting"]),
    Component("audio_multiroom", "audio_controller", True, True, ["ampli", "amply", "amplifier", "bo dieu khien am thanh", "arylic", "audio"]),
    Component("audio_multiroom", "speaker", True, False, ["loa", "speaker", "gan tran", "ngoai troi"]),
]
OPTIONS = [
    Option("door_phone", "lumi_basic_doorphone", "Lumi", ["lumi", "basic", "chuong", "man hinh", "door", "intercom"]), Option("door_phone", "akuvox_access", "Akuvox", ["akuvox", "chuong", "intercom", "access"]),
    Option("smart_lighting", "lumi_lighting", "Lumi", ["lumi", "den", "lighting", "downlight", "spotlight", "ray", "led", "driver"]), Option("smart_lighting", "philips_lighting", "Philips", ["philips", "den", "lighting", "led"]),
    Option("smart_lighting", "kingled_lighting", "KingLed", ["kingled", "king led", "den", "led", "downlight"]), Option("audio_multiroom", "lumi_audio", "Lumi", ["lumi", "loa", "am thanh", "audio", "sound"]),
]
GOODS = ["Đèn downlight LED", "Driver nguồn 24V", "Chuông cửa intercom", "Loa âm trần speaker", "Dimmer controller", "Ray nam châm", "Adapter PoE switch", "Ốc vít"]
MAKERS = ["Lumi", "Philips", "KingLed", "", "Akuvox"]
FAMILY = S.pick("p_size", ["smart_lighting", "door_phone", "audio_multiroom"])
GOOD, MAKER = S.pick("p_partkey", GOODS), S.pick("p_size", MAKERS)


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as product", f"{GOOD} as good", "p_name", f"coalesce({MAKER}, '') as maker", "CAST(p_retailprice AS DOUBLE) as cost", "p_retailprice * 2 as price")
    return part.select("product", K.search_text("good", "p_name", "maker").alias("text"), F.lower("maker").alias("supplier"), "cost", "price")


def pack_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.component_candidates(_products(spark, sf_dir), COMPONENTS, "lumi")
    return found.withColumn("score", F.round("score", 6))


def pack_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([c[:4] for c in COMPONENTS], "family string, role string, required boolean, auto boolean")
    return K.template_coverage(listed, K.component_candidates(_products(spark, sf_dir), COMPONENTS, "lumi"))


def pack_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.component_choice(K.component_candidates(_products(spark, sf_dir), COMPONENTS, "lumi"))


def pack_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").selectExpr(f"{FAMILY} as family", f"{GOOD} as good", "p_name").where("family is not null").select("family", K.search_text("good", "p_name").alias("text"))
    return K.suggestions(K.line_fit(lines, OPTIONS), K.option_products(_products(spark, sf_dir), OPTIONS)).withColumns({"cost": F.round("cost", 2), "revenue": F.round("revenue", 2)})


_L = S.flat("line")
_VALUES = "list_filter(list_transform(list_filter(list_transform(regexp_extract_all(coalesce(line, ''), '(?:[0-9]{1,3}(?:[.,][0-9]{3}){1,3}|[0-9]{5,10})'), lambda v: regexp_replace(v, '[.,]', '', 'g')), lambda v: length(v) between 5 and 10), lambda v: CAST(v AS BIGINT)), lambda v: v between 10000 and 999000000)"
_CODE = ", ".join(f"list_filter(regexp_extract_all(line, {S.quoted(p)}), lambda c: not regexp_matches(c, '(?i){D.NO_CODE}') and length(regexp_replace(c, '[^A-Za-z0-9]', '', 'g')) >= 4)[1]" for p in D.CODES)
_re = lambda x, p, g="'g'": f"regexp_replace({x}, {S.quoted('(?i)' + p)}, ' ', {g})"
_NAME = _re(_re(f"regexp_replace({_re(_L, D.MONEY)}, '^[0-9]+[.)\\-\\s]+', ' ')", D.UNITS), D.PRICE_WORDS)


def _sum(text: str, words: list[str], long: float, short: float) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN {long if len(w) >= 6 else short}::DOUBLE ELSE 0 END" for w in words)


_PROD = f"p as (select p_partkey as product, {S.plain(f'''concat_ws(' ', {GOOD}, p_name, coalesce({MAKER}, ''))''')} as text, lower(coalesce({MAKER}, '')) as supplier, p_retailprice as cost, p_retailprice * 2 as price from part)"
_COMP = "s as (" + " union all ".join(
    f"select '{c.family}' as family, '{c.role}' as role, {c.required} as required, {c.auto} as auto, product, price, least(0.99::DOUBLE, {_sum('text', c.words, 0.22, 0.14)} + CASE WHEN contains(supplier, 'lumi') or contains(text, 'lumi') THEN 0.18::DOUBLE ELSE 0 END) as score, {_sum('text', c.words, 1, 1)} as hits from p" for c in COMPONENTS
) + "), c as (select family, role, product, score, price, CAST(row_number() over (partition by family, role order by score desc, price, product) AS INTEGER) as place from s where hits >= 1 and score >= 0.22 qualify place <= 5)"
_OPTS = "o as (" + " union all ".join(
    f"select '{o.family}' as family, '{o.option}' as option, product, cost, price, least(0.98::DOUBLE, {_sum('text', [w for w in o.words if w != o.vendor.lower()], 0.14, 0.08)} + CASE WHEN contains(supplier, '{o.vendor.lower()}') or contains(text, '{o.vendor.lower()}') THEN 0.18::DOUBLE ELSE 0 END) as score, {_sum('text', [w for w in o.words if w != o.vendor.lower()], 1, 1)} as hits from p" for o in OPTIONS
) + ")"
_FITS = "f as (" + " union all ".join(f"select '{o.family}' as family, '{o.option}' as option, avg(least(0.95::DOUBLE, {_sum('text', o.words, 0.16, 0.09)})) as fit, count(*) as n_lines from l where family = '{o.family}' having count(*) > 0" for o in OPTIONS) + ")"

QUERIES = {f.__name__: f for f in (page_rows, pack_components, pack_coverage, pack_choice, pack_suggestions)}
ORACLES = {
    "page_rows": f"""with r as (select p_brand as file, p_size as page, p_partkey as line_no, {LINE} as line from part), v as (select *, {_L} as t, {_VALUES} as v, coalesce({_CODE}, '') as sku from r),
h as (select *, length(t) between 4 and 130 and len(v) = 0 and (upper(t) = t or {S.hit('t', D.SECTION_HEAD)}) as heads, substr(regexp_replace(line, '(?i)^bảng giá\\s*', ''), 1, 90) as title from v),
c as (select *, coalesce(last_value(CASE WHEN heads and title <> '' THEN title END ignore nulls) over (partition by file order by page nulls first, line_no rows between unbounded preceding and current row), 'Chung') as category, {_NAME} as n from h),
k as (select *, strpos(n, sku) as at_ from c where not heads and not (length(t) < 5 or {S.hit('t', D.SKIP_HEAD)} or {S.hit('t', D.SKIP_WORDS)}) and len(v) > 0),
d as (select *, CASE WHEN sku <> '' and at_ > 1 THEN substr(n, 1, at_ - 1) WHEN sku <> '' and at_ = 1 THEN ' ' || substr(n, length(sku) + 1) ELSE n END as m from k),
e as (select *, trim(substr({S.flat(f"regexp_replace(regexp_replace(m, {S.quoted('(?i)' + D.SPEC_HEAD + '.*$')}, ''), '[|•·]+', ' ', 'g')")}, 1, 90)) as short, list_sort(list_distinct(v)) as u from d),
g as (select *, CASE WHEN length(short) < 3 and sku <> '' THEN category || ' ' || sku ELSE short END as name from e)
select file, page, line_no, name, sku, category, CASE WHEN {S.hit('line', r'\b(bộ|bo|set)\b')} THEN 'Bộ' ELSE 'Cái' END as unit, u[1] as cost, CASE WHEN len(u) > 1 THEN u[-1] ELSE 0 END as listed, CASE WHEN len(u) > 2 THEN u[2] ELSE 0 END as retail,
  trim(substr({S.flat(_re('t', D.MONEY))}, 1, 160)) as specs from g where length(name) >= 3""",
    "pack_components": f"with {_PROD}, {_COMP} select family, role, product, round(score, 6) as score, price, place from c",
    "pack_coverage": f"""with {_PROD}, {_COMP}, m as (select distinct s.family, s.role, s.required, s.auto, c.family is not null as matched from s left join c using (family, role)),
n as (select family, count(*) as components, count(*) filter (required) as required, count(*) filter (required and matched) as required_matched, count(*) filter (auto and matched) as auto_ready from m group by 1),
v as (select *, CAST(CASE WHEN required > 0 THEN floor(required_matched / required * 100 + 0.5) ELSE 100 END AS BIGINT) as coverage from n)
select *, CASE WHEN coverage >= 100 THEN 'ready' WHEN coverage >= 50 THEN 'partial' ELSE 'weak' END as status from v""",
    "pack_choice": f"with {_PROD}, {_COMP} select family, role, first(product order by price, place) as budget, first(product order by place) as standard, first(product order by price desc, place) as premium from c group by 1, 2",
    "pack_suggestions": f"""with {_PROD}, {_OPTS}, l as (select {FAMILY} as family, {S.plain(f"concat_ws(' ', {GOOD}, p_name)")} as text from part where {FAMILY} is not null), {_FITS},
q as (select *, row_number() over (partition by family, option order by score desc, product) as place from o where hits >= 1 and score >= 0.18 qualify place <= 12),
t as (select family, option, count(*) as products, sum(CASE WHEN place <= 4 THEN cost ELSE 0 END) as cost, sum(CASE WHEN place <= 4 THEN price ELSE 0 END) as revenue from q group by 1, 2),
b as (select f.*, coalesce(products, 0) as products, coalesce(cost, 0) as cost, coalesce(revenue, 0) as revenue from f left join t using (family, option)),
r as (select *, least(0.99::DOUBLE, 0.34::DOUBLE * fit + 0.34::DOUBLE * least(1.0::DOUBLE, products::DOUBLE / greatest(2, least(8, n_lines))) + 0.2::DOUBLE * 0.65::DOUBLE + CASE WHEN products > 0 THEN 0.12::DOUBLE ELSE 0 END) as raw from b)
select family, option, CAST(floor(raw * 100 + 0.5) AS BIGINT) as score, CASE WHEN raw >= 0.72 THEN 'high' WHEN raw >= 0.48 THEN 'medium' ELSE 'low' END as confidence, products, round(cost, 2) as cost, round(revenue, 2) as revenue,
  CAST(row_number() over (partition by family order by floor(raw * 100 + 0.5) desc, option) AS INTEGER) as place from r qualify place <= 3""",
}

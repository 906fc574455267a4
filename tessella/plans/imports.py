"""Queries over headers, file names, variants of quotes and moved lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import cleaning as C
from tessella.operators import imports as I
from tessella.plans import sql as S
from tessella.plans.quoting import spread, table

WORDS = [
    "Tên hàng", "Mã SP", "MÔ TẢ sản phẩm", "Model", "Nhóm", "Hãng", "ĐVT", "Giá mới", "Giá niêm yết", "Giá bán lẻ thấp nhất", "Giá đại lý", "Đơn giá", "Thông số", "Hình ảnh", "", "STT", "Quy cách", "Xuất xứ", "ảnh", "Price",
]
FILES = ["Bảng giá Lumi 2024.xlsx", "bao_gia-Đèn Led Rạng Đông 12.05.2024.pdf", "SSE HOME price list.xls", "final copy v2.xlsx", "", "Catalog Nguyên Đà", "Cập nhật giá ABC-new.csv", "Hotline 0900.pdf", "Tổng hợp Philips.pdf", "Schneider 2023"]
CELLS = [S.pick(f"p_partkey * {a} + p_size * {b}", WORDS) for a, b in ((1, 0), (3, 1), (7, 2), (1, 3), (9, 1), (3, 5), (7, 7), (1, 9))]
FILE, SUPPLIER = S.pick("p_partkey", FILES), S.pick("p_size", ["", "Công ty Đèn  Việt!", "Lumi", ""])
VARIANTS = ["budget", "standard", "premium"]
VENDOR, TIER, TITLE = S.pick("p_partkey", ["Lumi", "", "Philips"]), S.pick("p_size", ["Phổ thông", "", "Cao cấp", "TP-Link"]), S.pick("p_partkey", ["Imou tiết kiệm", "Chung"])
SELLER = S.pick("p_size", ["Lumi", "Philips VN", "Khác"])
# Candidates 0, 1 and 2 of each line, and products with their prices.
_CANDIDATES = [f"(p_partkey * 7 + {k} * 13) % 200" for k in range(3)]
_SCORE = "cast((line + place) % 23 as double) / 20"
_LINES = "p_partkey as line, CASE WHEN p_partkey % 11 = 0 THEN p_partkey END as locked, CASE WHEN p_partkey % 4 = 1 THEN p_partkey + 1 END as suggested, CASE WHEN p_partkey % 8 = 1 THEN cast(p_size as double) / 100 END as suggested_score"
_PRODUCTS = f"p_partkey as product, p_name as name, p_brand as sku, {SELLER} as supplier, cast(p_size as double) * 400000 as price"


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.catalog_columns(spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey as sheet", f"array({', '.join(CELLS)}) as text"))


def file_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey as id", f"{FILE} as file", f"{SUPPLIER} as supplier")
    return files.select("id", I.file_supplier(F.col("file")).alias("supplier"), I.profile_key(F.col("file"), F.col("supplier")).alias("profile"), I.profile_key(F.col("file"), F.lit("")).alias("file_key"))


def variant_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    found = part.selectExpr("p_partkey as line", f"{VENDOR} as vendor", f"{TIER} as tier", f"{TITLE} as title", f"posexplode(array({', '.join(_CANDIDATES)})) as (place, product)")
    found = found.withColumns({"score": F.expr(_SCORE), "chosen": F.col("product") % 5 == 0}).join(_products(part), "product")
    lines = part.selectExpr("p_partkey as line", "CASE WHEN p_partkey % 11 = 0 THEN p_partkey END as locked", "CASE WHEN p_partkey % 4 = 1 THEN p_partkey + 1 END as suggested", "CASE WHEN p_partkey % 8 = 1 THEN cast(p_size as double) / 100 END as suggested_score")
    return I.variant_choices(lines, found, VARIANTS).withColumn("confidence", F.round("confidence", 6))


def _products(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_partkey as product", "p_name as name", "p_brand as sku", f"{SELLER} as supplier", "cast(p_size as double) * 400000 as price")


def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lines = part.selectExpr("p_brand as room", "p_partkey as line", "p_size as position")
    moves = part.groupBy(F.col("p_brand").alias("room")).agg(F.min("p_partkey").alias("line")).withColumn("by", F.when(F.col("line") % 2 == 0, 1).otherwise(-1))
    return I.moved_lines(lines, moves)


_FIELDS = [f for f, _ in I.CATALOG_FIELDS]
_FITS = {f: S.hit("x", p) for f, p in I.CATALOG_FIELDS}
_STEP = ", ".join(f"CASE WHEN pick = '{f}' THEN col ELSE s.{f} END as {f}" for f in _FIELDS)
_PICK = "CASE " + " ".join(f"WHEN s.{f} is null and list_contains(c.fits, '{f}') THEN '{f}'" for f in _FIELDS) + " END"
_RAW = r"trim(regexp_replace(regexp_replace(file, '(?i)\.(xlsx|xls|csv|pdf)$', ''), '[_\-]+', ' ', 'g'))"
_CLEANED = "raw"
for _p in I.FILE_NOISE:
    _CLEANED = f"regexp_replace({_CLEANED}, {S.quoted('(?i)' + _p)}, ' ', 'g')"
_KEY = lambda x: f"trim(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_FOLDED = "replace(replace(strip_accents({0}), 'đ', 'd'), 'Đ', 'D')"
_BROKEN = f"({S.hit('w', C.WEIRD)} or {S.hit('w', C.MOJIBAKE)})"
_FILE_KEY = S.flat(f"regexp_replace({_KEY('file')}, {S.quoted(I.KEY_NOISE)}, '', 'g')")
_NAMED, _VENDOR = _KEY("supplier || ' ' || name || ' ' || sku"), _KEY("vendor")
_DEAR = "least(220::DOUBLE, price / 100000)"
_POINTS = f"""CASE variant WHEN 'budget' THEN base + (220::DOUBLE - {_DEAR}) + CASE WHEN regexp_matches({_KEY("CASE WHEN tier = '' THEN title ELSE tier END")}, '{I.CHEAP}') THEN 70 ELSE 0 END
  WHEN 'premium' THEN base + {_DEAR} + CASE WHEN regexp_matches({_KEY("tier || ' ' || title || ' ' || supplier")}, '{I.DEAR}') THEN 90 ELSE 0 END ELSE base + 40 END"""

QUERIES = {f.__name__: f for f in (catalog_columns, file_suppliers, variant_choices, moved_lines)}
ORACLES = {
    "catalog_columns": f"""with recursive t as (select p_partkey as sheet, [{', '.join(CELLS)}] as t from part), d as (select sheet, CAST(unnest(range(len(t))) AS INTEGER) as col, trim(lower(unnest(t))) as x from t),
c as (select sheet, col, list_filter([{', '.join(f"CASE WHEN {test} THEN '{f}' END" for f, test in _FITS.items())}], lambda f: f is not null) as fits from d),
s as (select sheet, -1 as pos, {', '.join(f'NULL::INTEGER as {f}' for f in _FIELDS)} from t union all
  select sheet, col as pos, {_STEP} from (select s.*, c.col, {_PICK} as pick from s join c on c.sheet = s.sheet and c.col = s.pos + 1) s)
select sheet, {', '.join(_FIELDS)} from s where pos = {len(CELLS) - 1}""",
    "file_suppliers": f"""with f as (select p_partkey as id, {FILE} as file, {SUPPLIER} as supplier from part), r as (select *, {_RAW} as raw, {_KEY('supplier')} as own from f),
l as (select *, {S.flat(f"regexp_replace({_FOLDED.format(_CLEANED)}, {S.quoted('(?i)' + I.FOLDED_NOISE)}, ' ', 'g')")} as rest from r), w as (select *, CASE WHEN rest = '' THEN raw ELSE rest END as w from l)
select id, coalesce({S.first_of(S.plain('raw'), I.FILE_SUPPLIERS)}, CASE WHEN w = '' or {_BROKEN} or length(w) > 80 or {S.hit('w', C.CONTACT)} or {S.hit('w', C.CATEGORY_JUNK)} THEN '' ELSE {S.flat('w')} END) as supplier,
  substr(CASE WHEN own <> '' THEN own ELSE {_FILE_KEY} END, 1, 80) as profile, substr({_FILE_KEY}, 1, 80) as file_key from w""",
    "variant_choices": f"""with c as (select p_partkey as line, {VENDOR} as vendor, {TIER} as tier, {TITLE} as title, unnest([0, 1, 2]) as place, unnest([{', '.join(_CANDIDATES)}]) as product from part),
p as (select {_PRODUCTS} from part), k as (select *, {_SCORE} as score from c join p using (product)),
b as (select *, score * 1000 + CASE WHEN product % 5 = 0 THEN 140 ELSE 0 END + CASE WHEN {_VENDOR} <> '' and contains({_NAMED}, {_VENDOR}) THEN 95 ELSE 0 END as base from k where score >= {I.LEAST_SCORE}),
v as (select *, {_POINTS} as points from b, (values ('budget'), ('standard'), ('premium')) n(variant)),
t as (select * from v qualify row_number() over (partition by line, variant order by points desc, place) = 1), l as (select {_LINES}, n.variant from part, (values ('budget'), ('standard'), ('premium')) n(variant))
select variant, line, coalesce(locked, t.product, suggested) as product, CASE WHEN locked is not null THEN 'user_locked' WHEN t.product is not null THEN 'variant_suggestion' ELSE 'suggested' END as source,
  round(CASE WHEN locked is not null THEN 1::DOUBLE WHEN t.product is not null THEN t.score ELSE coalesce(suggested_score, 0.45) END, 6) as confidence from l left join t using (line, variant) where coalesce(locked, t.product, suggested) is not null""",
    "moved_lines": """with p as (select p_brand as room, p_partkey as line, row_number() over (partition by p_brand order by p_size, p_partkey) as place, count(*) over (partition by p_brand) as n from part),
m as (select room, place as a, place + CASE WHEN line % 2 = 0 THEN 1 ELSE -1 END as b, n from p qualify line = min(line) over (partition by room))
select room, line, CAST(CASE WHEN b between 1 and m.n and place = a THEN b WHEN b between 1 and m.n and place = b THEN a ELSE place END AS INTEGER) as place from p join m using (room)""",
}

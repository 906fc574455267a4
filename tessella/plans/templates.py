"""Templates of the catalogue's sheets: saved, put over found maps, suggested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import templates as T
from tessella.plans import sql as S
from tessella.plans.quoting import table

WORDS = ["Mã SP", "Tên hàng", "Đơn giá", "ĐVT", "Hãng", "Thông số", "", "Model"]
FILES = ["Lumi.xlsx", "Philips VN.xls", "", "Kaadas.pdf"]
# Owners have 25 templates a size at most, so a sheet meets few.
OWNER, FILE = "concat(p_brand, '-', p_size % 5)", S.pick("p_partkey", FILES)
_HEADS = [S.pick(f"p_partkey * {a} + p_size * {b}", WORDS) for a, b in ((1, 1), (3, 2), (5, 1))]


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("*", f"array({', '.join(_HEADS)}) as headers", f"{FILE} as file")
    return part.selectExpr(f"{OWNER} as owner", "concat('k', p_partkey) as key", "p_partkey * 7 % 1000 as saved_at", "concat(file, ' ', p_size % 3) as name", "headers", "file").withColumn("signature", T.signature(F.col("headers"), F.col("file"))).drop("headers", "file")


def templates_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = lambda which: part.where(which).groupBy(F.expr(OWNER).alias("owner"), F.expr("concat('k', p_partkey % 30)").alias("key")).agg(F.max("p_partkey").alias("id")).withColumn("saved_at", F.expr("id * 7 % 1000"))
    return T.saved(rows("p_partkey % 2 = 0"), rows("p_partkey % 2 = 1"), most=5)


def template_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "part").selectExpr(f"{OWNER} as owner", "p_partkey as sheet", f"array({', '.join(_HEADS)}) as headers", f"{FILE} as file")
    kept = T.saved(_templates(spark, sf_dir).limit(0), _templates(spark, sf_dir))
    return T.suggestions(sheets, kept)


def maps_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    maps = part.selectExpr("p_partkey % 500 as template", "p_partkey as sheet", "p_size as name", "CASE WHEN p_size % 3 = 0 THEN p_size END as price", "p_size / 60.0D as confidence")
    kept = part.where("p_partkey % 4 = 0").selectExpr("p_partkey % 500 as template", "p_partkey + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END as sheet", "CASE WHEN p_size % 2 = 0 THEN 1 END as name", "2 as price")
    return T.with_saved(maps, kept.dropDuplicates(["template", "sheet"]), ["name", "price"])


_KEY = lambda x: f"trim(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_SUPPLIER = S.pick("p_partkey", ["lumi", "philips vn", "", "kaadas"])
_LABELS = f"list_filter([{', '.join(_KEY(h) for h in _HEADS)}], lambda h: h <> '')"
_WORDS = "list_distinct(list_filter(string_split(array_to_string(labels, ' '), ' '), lambda w: w <> ''))"

QUERIES = {f.__name__: f for f in (templates_saved, template_suggestions, maps_overridden)}
ORACLES = {
    "templates_saved": f"""with a as (select {OWNER} as owner, concat('k', p_partkey % 30) as key, p_partkey % 2 as fresh, max(p_partkey) as id from part group by all),
b as (select owner, key, id, id * 7 % 1000 as saved_at from a qualify row_number() over (partition by owner, key order by fresh desc) = 1)
select * from b qualify row_number() over (partition by owner order by saved_at desc, key desc) <= 5""",
    "template_suggestions": f"""with p as (select {OWNER} as owner, p_partkey as sheet, 'k' || p_partkey as key, p_partkey * 7 % 1000 as saved_at, {_SUPPLIER} as supplier, {_LABELS} as labels, {_KEY(FILE + " || ' ' || p_size % 3")} as name from part),
w as (select *, {_WORDS} as words, supplier || '::3::' || array_to_string(labels, '|') as sig from p),
t as (select * from w qualify row_number() over (partition by owner order by saved_at desc, key desc) <= {T.KEPT}),
s as (select w.owner, w.sheet, t.key, t.saved_at, floor((CASE WHEN w.sig = t.sig THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN w.supplier <> '' and contains(t.name, w.supplier) THEN {T.SUPPLIER_POINTS}::DOUBLE ELSE 0 END
  + CASE WHEN len(w.words) > 0 and len(t.words) > 0 THEN len(list_intersect(w.words, t.words))::DOUBLE / greatest(len(w.words), len(t.words)) ELSE 0 END) * 100 + 0.5) / 100 as score from w join t using (owner)),
r as (select *, row_number() over (partition by owner, sheet order by score desc, saved_at desc, key) as place from s where score > {T.LEAST}) select owner, sheet, key, score, CAST(place AS INTEGER) as place from r where place <= {T.MOST}""",
    "maps_overridden": f"""with m as (select p_partkey % 500 as template, p_partkey as sheet, p_size as name, CASE WHEN p_size % 3 = 0 THEN p_size END as price, p_size / 60.0::DOUBLE as confidence from part),
k as (select p_partkey % 500 as template, p_partkey + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END as sheet, CASE WHEN p_size % 2 = 0 THEN 1 END as sn, 2 as sp from part where p_partkey % 4 = 0)
select m.template, m.sheet, coalesce(sn, name) as name, coalesce(sp, price) as price, CASE WHEN k.sheet is not null THEN greatest(confidence, {T.SURE}::DOUBLE) ELSE confidence END as confidence, m.template in (select template from k) as known
from m left join k on k.template = m.template and k.sheet = m.sheet""",
}

"""Queries with memory: ranked matches with learned choices, correction rules, profiles and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import learning as L
from tessella.operators import ranking as R
from tessella.plans import sql as S
from tessella.plans.quoting import table

MODEL = S.pick("p_partkey", ["LM-{}", "", "BRAND-1", "x", "sbx501"]).replace("{}", "4")
CODE = "concat(replace(p_brand, '#', '-'), CASE WHEN p_size % 3 = 0 THEN '' ELSE '-4C0' END)"
NOTE = S.pick("p_size", ["", "cai bo", "special offer", "Brand-1-4C0"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines, numbered by the part they first occur in."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name as name", f"{MODEL} as model", "p_type as category", f"{NOTE} as note")
    return part.groupBy("name", "model", "category", "note").agg(F.min("p_partkey").alias("line"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{CODE} as sku", "p_name as name", "p_type as category", "p_brand as supplier")
    return part.groupBy("sku", "name", "category", "supplier").agg(F.min("p_partkey").alias("product"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line was once chosen by hand for the product of its size."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey as pos", "p_size as product", f"{MODEL} as model", "p_name as name", "p_type as category")


def bom_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, products = _lines(spark, sf_dir), _products(spark, sf_dir)
    known = R.recall(lines, R.remember(_choices(spark, sf_dir), "pos")).join(products.select("product"), "product", "left_semi").select("line", "product")
    return R.rank(lines, products, known)


def bom_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best(bom_ranking(spark, sf_dir)).select("line", "product", "score", "learned")


def learned_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.remember(_choices(spark, sf_dir), "pos")


SKU, CAT, UNIT = S.pick("p_partkey + p_size", ["A-{n}", "", "b.{n}", "n_{n}"]), S.pick("p_size", ["Chung", "Đèn", "", "Báo giá", "Khóa"]), S.pick("p_partkey", ["Cái", "bộ", ""])
CODE_OF = f"replace({SKU}, '{{n}}', CAST(p_size AS STRING))"


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as pos", "p_name as name", f"{CODE_OF} as sku", f"{CAT} as category", "p_brand as supplier", f"{UNIT} as unit", "CAST(p_retailprice AS DOUBLE) as cost", "p_partkey % 3 = 0 as edited", "concat(p_name, ' ', p_type) as raw"
    ).where("sku is not null")


def correction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rules(_accepted(spark, sf_dir), "pos")


def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.supplier_profiles(_accepted(spark, sf_dir))


def learning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _accepted(spark, sf_dir)
    return L.stats(L.rules(accepted, "pos"), L.supplier_profiles(accepted))


def corrections_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _accepted(spark, sf_dir).selectExpr(
        "pos as id", "CASE WHEN pos % 5 = 0 THEN '' WHEN pos % 5 = 1 THEN sku ELSE name END as name", "CASE WHEN pos % 4 = 0 THEN '' ELSE sku END as sku", "CASE WHEN pos % 2 = 0 THEN 'Chung' ELSE category END as category",
        "CASE WHEN pos % 6 = 0 THEN '' ELSE supplier END as supplier", "CASE WHEN pos % 3 = 0 THEN 'cái' ELSE unit END as unit", "CASE WHEN pos % 7 = 0 THEN 0.0D ELSE cost END as cost", "raw as raw_text",
    )
    return L.apply(given, L.rules(_accepted(spark, sf_dir), "pos"))


_LEARN = lambda x: f"trim(regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"
_COMPACT = lambda x: f"regexp_replace(replace(strip_accents(lower(coalesce({x}, ''))), 'đ', 'd'), '[^a-z0-9]', '', 'g')"
_SKUKEY = lambda x: f"regexp_replace(lower(trim(coalesce({x}, ''))), '[\\s\\-/._]', '', 'g')"
_WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array({S.plain(x)}, '[^a-z0-9]+'), lambda w: length(w) >= 2 and w not in ({', '.join(map(S.quoted, R.STOP_WORDS))})))"
_CHOICES = f"""c as (select p_partkey as pos, p_size as product, {S.plain(MODEL)} as m, {S.plain('p_name')} || CASE WHEN p_type <> '' THEN ' | ' || {S.plain('p_type')} ELSE '' END as n from part),
r as (select 'by_model' as kind, m as key, arg_max(product, pos) as product from c where length(m) >= 3 group by 2 union all select 'by_name', n, arg_max(product, pos) from c where length(n) >= 8 group by 2)"""
_RANK = f"""{_CHOICES}, l as (select p_name as name, {MODEL} as model, p_type as category, {NOTE} as note, min(p_partkey) as line from part group by all),
p as (select {CODE} as sku, p_name as name, p_type as category, p_brand as supplier, min(p_partkey) as product from part group by all),
a as (select line, {S.plain('model')} as m, {S.plain('category')} as c, {_WORDS("concat_ws(' ', name, model, category, note)")} as w, {S.plain('name')} || CASE WHEN category <> '' THEN ' | ' || {S.plain('category')} ELSE '' END as n from l),
b as (select product, {S.plain('sku')} as k, {S.plain('category')} as c, {S.plain("concat_ws(' ', name, sku, category, supplier)")} as t, {_WORDS("concat_ws(' ', name, sku, category, supplier)")} as w from p),
s as (select line, product, false as learned, CASE WHEN m <> '' and m = k THEN 0.98::DOUBLE WHEN m <> '' and k <> '' and (contains(m, k) or contains(k, m)) and least(length(m), length(k)) >= 4 THEN 0.9::DOUBLE
  WHEN length(m) >= 4 and contains(t, m) THEN 0.84::DOUBLE ELSE least(0.82::DOUBLE, len(list_intersect(a.w, b.w))::DOUBLE / greatest(least(len(a.w), len(b.w)), 1) * 0.78::DOUBLE + CASE WHEN m <> '' and contains(t, substr(m, 1, 6)) THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN a.c <> '' and b.c <> '' and contains(b.c, substr(a.c, 1, 5)) THEN 0.08::DOUBLE ELSE 0 END) END as score from a, b),
o as (select line, coalesce(x.product, y.product) as product from a left join (select * from r where kind = 'by_model') x on a.m = x.key left join (select * from r where kind = 'by_name') y on a.n = y.key),
u as (select line, product, learned, score from s where score >= 0.32 and (line, product) not in (select line, product from o where product is not null) union all select line, product, true, 1.0::DOUBLE from o where product in (select product from b)),
k as (select *, CAST(row_number() over (partition by line order by learned desc, score desc, product) AS INTEGER) as rank from u),
f as (select line, CAST(product AS BIGINT) as product, floor(score * 100 + 0.5) / 100 as score, CASE WHEN learned or score >= 0.78 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END as confidence, learned, rank from k where rank <= 5)"""
_ACC = f"""acc as (select p_partkey as pos, p_name as name, {CODE_OF.replace('AS STRING', 'AS VARCHAR')} as sku, {CAT} as category, p_brand as supplier, {UNIT} as unit, p_retailprice as cost, p_partkey % 3 = 0 as edited, p_name || ' ' || p_type as raw from part where p_size is not null),
ks as (select 'sku' as kind, {_SKUKEY('sku')} as key, * from acc where {_SKUKEY('sku')} <> '' union all select 'raw', {_COMPACT('raw')}, * from acc where length({_COMPACT('raw')}) >= 6),
rules as (select kind, key, count(*) as accepted, count(*) filter (edited) as edited, {', '.join(f'arg_max({f}, pos) as {f}' for f in L.FIELDS)} from ks group by 1, 2),
prof as (select substr({_LEARN('supplier')}, 1, 80) as profile, f.field, f.value from acc, unnest([{{'field': 'category', 'value': trim(category)}}, {{'field': 'supplier', 'value': trim(supplier)}}, {{'field': 'unit', 'value': trim(unit)}}]) as x(f) where f.value <> '')"""


def _change(f: str, r: str) -> str:
    blank = f"coalesce(g.{f}::VARCHAR, '') = ''"
    has = f"coalesce({r}.{f}::VARCHAR, '') <> ''"
    return {
        "name": f"({has} and ({blank} or ({_COMPACT('g.name')} <> {_COMPACT(r + '.name')} and length({_COMPACT('g.name')}) <= 18 and length({_COMPACT(r + '.name')}) > length({_COMPACT('g.name')}) + 6)))",
        "category": f"({_LEARN('g.category')} in ({', '.join(map(S.quoted, L.PLACEHOLDERS))}) and {has})", "unit": f"(({blank} or {_LEARN('g.unit')} = 'cai') and {has})",
        "cost": f"(coalesce(g.cost, 0) <= 0 and {r}.cost > 0)",
    }.get(f, f"({blank} and {has})")


_ANY = lambda r: f"({r}.key is not null and coalesce({' or '.join(_change(f, r) for f in L.FIELDS)}, false))"

QUERIES = {f.__name__: f for f in (bom_ranking, bom_best, learned_choices, correction_rules, supplier_profiles, learning_stats, corrections_applied)}
ORACLES = {
    "bom_ranking": f"with {_RANK} select * from f",
    "bom_best": f"with {_RANK} select line, product, score, learned from f where rank = 1 and (learned or score >= 0.5)",
    "learned_choices": f"with {_CHOICES} select * from r",
    "correction_rules": f"with {_ACC} select * from rules",
    "supplier_profiles": f"with {_ACC} select profile, field, value, count(*) as n from prof where profile <> '' group by 1, 2, 3",
    "learning_stats": f"with {_ACC} select (select count(*) from rules where kind = 'sku') as sku_rules, (select count(*) from rules where kind = 'raw') as raw_rules, (select count(distinct profile) from prof where profile <> '') as profiles",
    "corrections_applied": f"""with {_ACC}, g as (select pos as id, CASE WHEN pos % 5 = 0 THEN '' WHEN pos % 5 = 1 THEN sku ELSE name END as name, CASE WHEN pos % 4 = 0 THEN '' ELSE sku END as sku, CASE WHEN pos % 2 = 0 THEN 'Chung' ELSE category END as category,
  CASE WHEN pos % 6 = 0 THEN '' ELSE supplier END as supplier, CASE WHEN pos % 3 = 0 THEN 'cái' ELSE unit END as unit, CASE WHEN pos % 7 = 0 THEN 0.0::DOUBLE ELSE cost END as cost, raw as raw_text from acc),
h as (select g.*, CASE WHEN {_ANY('x')} THEN 'sku' WHEN {_ANY('y')} THEN 'raw' ELSE 'none' END as how,
  {', '.join(f"CASE WHEN {_ANY('x')} THEN CASE WHEN {_change(f, 'x')} THEN x.{f} ELSE g.{f} END WHEN {_ANY('y')} and {_change(f, 'y')} THEN y.{f} ELSE g.{f} END as new_{f}" for f in L.FIELDS)}
  from g left join (select * from rules where kind = 'sku') x on {_SKUKEY('g.sku')} = x.key left join (select * from rules where kind = 'raw') y on {_COMPACT('coalesce(g.raw_text, g.name)')} = y.key)
select id, how, {', '.join(f'new_{f} as {f}' for f in L.FIELDS)} from h""",
}

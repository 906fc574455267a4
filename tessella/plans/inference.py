"""Queries that tell what texts are about or look like: domains, amounts, junk, codes, roman order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import inference as I
from tessella.functions import products as P
from tessella.operators import catalog, scoring
from tessella.plans.quoting import table


def source_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "text")
    return scoring.detect_domain(docs, "source", "doc_id", F.col("text"))


def price_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", P.money_values(F.col("text")).alias("v"))
    return docs.select("doc_id", F.size("v").cast("long").alias("n_amounts"), P.price_fields(F.col("v")).alias("p")).select("doc_id", "n_amounts", "p.*")


NAME = """CASE WHEN p_size % 5 = 0 THEN concat('- ', p_name) WHEN p_size % 7 = 0 THEN concat(p_size, ') ', p_name) WHEN p_size % 3 = 0 THEN concat(p_name, ' Bảo hành ', p_size)
  WHEN p_size % 11 = 0 THEN repeat(concat(p_name, ' '), 12) ELSE p_name END"""
COST, SKU = "CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0 END", "CASE WHEN p_size % 4 = 1 THEN p_brand ELSE ' ' END"


def catalog_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{NAME} as name", f"{COST} as cost", f"{SKU} as sku")
    return catalog.without_junk(part).select("p_partkey", "name")


QUERY = "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(concat(p_name, p_size)) WHEN 2 THEN concat(p_name, '-', p_size) ELSE upper(p_name) END"


def code_or_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{QUERY} as q")
    code = I.looks_like_code(F.col("q"))
    return part.select("p_partkey", F.when(code, "").otherwise(F.col("q")).alias("name"), F.when(code, F.col("q")).otherwise("").alias("sku"))


def roman_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(I.roman(F.col("p_size") - 2), F.lit(". "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), I.roman_order(title).alias("place"))


_HIT = ", ".join(f"count(*) filter ({' or '.join(f'''contains(t, '{w}')''' for w in words)}) as {d}" for d, words in I.DOMAIN_WORDS.items())
_BEST = " ".join(f"WHEN {d} = top THEN '{d}'" for d in I.DOMAIN_WORDS)

QUERIES = {f.__name__: f for f in (source_domains, price_fields, catalog_cleanup, code_or_name, roman_scopes)}
ORACLES = {
    "source_domains": f"""with s as (select source, lower(coalesce(text, '')) as t from documents where source is not null qualify row_number() over (partition by source order by doc_id) <= 50),
c as (select source, count(*) as n, {_HIT} from s group by 1), g as (select *, greatest({', '.join(I.DOMAIN_WORDS)}) as top from c)
select source, CASE WHEN top = 0 THEN 'general' {_BEST} END as domain, top / n as share from g""",
    "price_fields": """with f as (select doc_id, regexp_extract_all(coalesce(text, ''), '(?:[0-9]{1,3}(?:[.,][0-9]{3}){1,3}|[0-9]{5,10})') as m from documents),
d as (select doc_id, list_filter(list_transform(m, lambda x: replace(replace(x, '.', ''), ',', '')), lambda x: length(x) between 5 and 10) as m from f),
v as (select doc_id, list_sort(list_distinct(list_filter(list_transform(m, lambda x: x::BIGINT), lambda n: n between 10000 and 999000000))) as v from d)
select doc_id, len(v) as n_amounts, CAST(coalesce(v[1], 0) AS BIGINT) as cost, CAST(CASE WHEN len(v) > 1 THEN v[-1] ELSE 0 END AS BIGINT) as listed, CAST(CASE WHEN len(v) > 2 THEN v[2] ELSE 0 END AS BIGINT) as retail from v""",
    "catalog_cleanup": f"""with p as (select p_partkey, {NAME} as name, {COST} as cost, {SKU} as sku from part)
select p_partkey, name from p where not (regexp_matches(trim(name), '^[-•*+]') or regexp_matches(trim(name), '^[0-9]+[.)]\\s')
  or (cost <= 0 and trim(sku) = '' and (regexp_matches(lower(name), '{I.TERMS}') or length(trim(name)) > 80)))""",
    "code_or_name": f"""with p as (select p_partkey, {QUERY} as q from part), c as (select *, contains(q, '-') or contains(q, '/') or (upper(q) = q and regexp_matches(q, '[0-9]')) as code from p)
select p_partkey, CASE WHEN code THEN '' ELSE q END as name, CASE WHEN code THEN q ELSE '' END as sku from c""",
    "roman_scopes": """with r as (select p_partkey, p_name, p_size - 2 as k, greatest(p_size - 2, 0) as n from part),
t as (select p_partkey, k, repeat('X', CAST(n // 10 AS BIGINT)) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] || '. ' || p_name as title from r)
select p_partkey, title, CAST(CASE WHEN k between 1 and 10 THEN k ELSE 99 END AS INTEGER) as place from t""",
}

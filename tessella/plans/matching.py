"""Queries that resolve items to catalogue products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import match_key, sku_key
from tessella.operators import matching
from tessella.plans.quoting import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, and in `asked` a name as an item would have it: without its first letter."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("substr(p_name, 2)").alias("asked"), "p_brand", "p_size")


def sku_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    code = sku_key(F.concat_ws("-", "p_brand", "p_size"))
    known = matching.last_by_key(part, code)
    return part.select("id", code.alias("key")).join(known, "key").select("id", "product")


def name_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    key = match_key(F.col("name"))
    return part.select("id", key.alias("key")).join(matching.last_by_key(part, key), "key").select("id", "product")


def fuzzy_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    items = part.select("id", match_key(F.col("asked")).alias("key"))
    first = part.groupBy(match_key(F.col("name")).alias("key")).agg(F.min("id").alias("product"))
    return items.join(matching.fuzzy_top1(items, first), "key").select("id", "product", F.round("score", 6).alias("score"))


def overlap_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _part(spark, sf_dir).select("name").distinct()
    return matching.overlap_top(names, names)


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    code = sku_key(F.concat_ws("-", "p_brand", "p_size"))
    catalog = part.where("p_size > 10").select("id", match_key(F.col("name")).alias("name_key"), code.alias("code_key"))
    items = part.select(
        "id", match_key(F.when(F.col("p_size") % 3 == 0, F.col("name")).when(F.col("p_size") % 3 == 1, F.col("asked")).otherwise(F.concat("name", F.lit(" special offer")))).alias("name_key"),
        F.when(F.col("p_size") % 2 == 0, code).otherwise("").alias("code_key"),
    )
    corrections = spark.createDataFrame([("redwidget", 7), ("luebolt", 9)], "key string, product long")
    return matching.cascade(items, catalog, corrections).select("id", "product", "how", F.round("score", 6).alias("score"))


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_SKU = "regexp_replace(lower(p_brand || '-' || p_size), '[\\s\\-/._]', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_DICE = "CAST(2 * len(list_intersect(a.g, b.g)) AS DOUBLE) / (len(a.g) + len(b.g))"

QUERIES = {f.__name__: f for f in (sku_exact_match, name_last_wins, fuzzy_top1, overlap_top5, match_cascade)}
ORACLES = {
    "sku_exact_match": f"with k as (select p_partkey as id, {_SKU} as key from part) select id, max(id) over (partition by key) as product from k",
    "name_last_wins": f"with k as (select p_partkey as id, {_KEY.format('p_name')} as key from part) select id, max(id) over (partition by key) as product from k",
    "fuzzy_top1": f"""with i as (select p_partkey as id, {_KEY.format('substr(p_name, 2)')} as key from part), c as (select {_KEY.format('p_name')} as key, min(p_partkey) as product from part group by 1),
a as (select key, {_GRAMS.format('key')} as g from (select distinct key from i)), b as (select key, product, {_GRAMS.format('key')} as g from c),
s as (select a.key, b.product, {_DICE} as score from a, b where {_DICE} > CAST(0.82 AS DOUBLE) qualify row_number() over (partition by a.key order by {_DICE} desc, b.product) = 1)
select id, product, round(score, 6) as score from i join s using (key)""",
    "overlap_top5": """with n as (select distinct p_name as name from part), w as (select name, list_distinct(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) as w from n),
s as (select a.name, b.name as other, CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / least(len(a.w), len(b.w)) as overlap from w a, w b)
select name, other, overlap, row_number() over (partition by name order by overlap desc, other) as rank from s where overlap >= 0.32 qualify rank <= 5""",
    "match_cascade": f"""with c as (select p_partkey as id, {_KEY.format('p_name')} as name_key, {_SKU} as code_key from part where p_size > 10),
i as (select p_partkey as id, {_KEY.format("CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN substr(p_name, 2) ELSE p_name || ' special offer' END")} as name_key, CASE WHEN p_size % 2 = 0 THEN {_SKU} ELSE '' END as code_key from part),
l(name_key, learned) as (values ('redwidget', 7), ('luebolt', 9)), k as (select code_key, max(id) as by_code from c where code_key <> '' group by 1), m as (select name_key, max(id) as by_name, min(id) as product from c group by 1),
a as (select name_key, {_GRAMS.format('name_key')} as g from (select distinct name_key from i)), b as (select name_key, product, {_GRAMS.format('name_key')} as g from m),
s as (select a.name_key, b.product as near, {_DICE} as near_score from a, b where {_DICE} > CAST(0.82 AS DOUBLE) qualify row_number() over (partition by a.name_key order by {_DICE} desc, b.product) = 1)
select i.id, CAST(coalesce(learned, by_code, by_name, near) AS BIGINT) as product,
  CASE WHEN learned is not null THEN 'correction' WHEN by_code is not null THEN 'sku' WHEN by_name is not null THEN 'name' WHEN near is not null THEN 'fuzzy' ELSE 'none' END as how,
  round(CASE WHEN learned is not null or by_code is not null THEN 1e0 WHEN by_name is not null THEN 95e-2 WHEN near is not null THEN near_score ELSE 0e0 END, 6) as score
from i left join l using (name_key) left join k using (code_key) left join m using (name_key) left join s using (name_key)""",
}

"""Queries on the catalogue: search, suppliers, price updates, merge, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import match_key
from tessella.operators import catalog as C
from tessella.operators import scoring
from tessella.plans.quoting import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("supplier"), F.col("p_size").alias("size"), (F.col("p_retailprice") * 1000).alias("cost"))


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search box: the first 20 hits."""
    return C.search(_part(spark, sf_dir), "WIDGET").orderBy("id").limit(20).select("id", "name", "supplier")


def supplier_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).where("supplier <> ''")
    return part.groupBy("supplier").agg(F.min("id").alias("first_seen"), F.count("*").alias("products"))


def bulk_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bulk_percent(_part(spark, sf_dir), "Brand#4", -7.5).select("id", "supplier", "cost")


def _feed(part: DataFrame) -> DataFrame:
    """A supplier's list: two thirds at new prices, some codes unknown, some blank."""
    code = F.when(F.col("size") % 11 == 0, "  ").when(F.col("size") % 7 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.concat(F.lit(" P-"), "id", F.lit(" ")))
    price = F.when(F.col("size") % 3 == 0, F.col("cost")).otherwise(F.floor(F.col("cost") + 1500.0).cast("double"))
    return part.select(code.alias("sku"), price.alias("price"))


def price_update_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    return C.price_update(part.withColumn("sku", F.concat(F.lit("p-"), "id")), _feed(part)).select("sku", "status", "percent")


def price_update_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_update_split(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).withColumn("sku", F.concat_ws("-", "name", "supplier"))
    old = part.where("size <= 30").groupBy("sku").agg(F.min(F.struct("id", "name", "supplier", "cost")).alias("p")).select("sku", "p.*")
    new = part.where("size > 20").withColumns({"cost": F.when(F.col("size") % 2 == 0, 0.0).otherwise(F.col("cost") + 1), "name": F.upper("name")})
    return C.merge(old, new, match_key(F.col("sku")))


def validate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scoring.scored(_items(spark, sf_dir), 0.8)
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ",")
    return lines.select("id", codes.alias("issues"), (F.floor(F.col("confidence") * 100 + 0.5) / 100).alias("confidence"), "status", "final_status")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with gaps of every kind, told by their size and place."""
    part = _part(spark, sf_dir)
    name = F.when(F.col("id") % 17 == 0, "").when(F.col("id") % 19 == 0, F.concat("name", F.lit(" VAT"))).otherwise(F.col("name"))
    sku = F.when(F.col("id") % 5 != 0, F.concat(F.lit("P-"), "id"))
    price = F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 11 == 0, 500).otherwise(F.floor(F.col("cost") + 0.5)).cast("long")
    return part.select(
        "id", name.alias("name"), sku.alias("sku"), price.alias("price"), ((F.col("id") % 13 == 0) & sku.isNull()).alias("subtotal"),
        F.when(F.col("id") % 3 != 0, F.lit(0.9)).alias("match_score"),
    )


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.summary(scoring.scored(_items(spark, sf_dir), 0.8))


_P = "p as (select p_partkey as id, p_name as name, p_brand as supplier, p_size as size, p_retailprice * 1000 as cost from part)"
_UPDATE = f"""with {_P}, f as (select CASE WHEN size % 11 = 0 THEN '  ' WHEN size % 7 = 0 THEN 'new-' || id ELSE ' P-' || id || ' ' END as sku, CASE WHEN size % 3 = 0 THEN cost ELSE floor(cost + 1500) END as price from p),
u as (select f.sku, CASE WHEN p.id is null THEN 'new' WHEN floor(p.cost + 0.5) <> floor(price + 0.5) THEN 'updated' ELSE 'unchanged' END as status,
  CAST(CASE WHEN coalesce(p.cost, 0) = 0 THEN 0 ELSE floor((price - p.cost) / p.cost * 100 + 0.5) END AS BIGINT) as percent from f left join p on lower(trim(f.sku)) = 'p-' || p.id where trim(f.sku) <> '')"""
_SCORED = f"""with {_P}, i as (select id, CASE WHEN id % 17 = 0 THEN '' WHEN id % 19 = 0 THEN name || ' VAT' ELSE name END as name, CASE WHEN id % 5 <> 0 THEN 'P-' || id END as sku,
  CAST(CASE WHEN id % 7 = 0 THEN 0 WHEN id % 11 = 0 THEN 500 ELSE floor(cost + 0.5) END AS BIGINT) as price, id % 13 = 0 and id % 5 = 0 as subtotal, CASE WHEN id % 3 <> 0 THEN 9e-1 END as match_score from p),
v as (select *, length(trim(name)) < 2 as a, price = 0 as b, price between 1 and 999 as c, sku is null as d, contains(lower(name), 'vat') as e from i),
x as (select *, a::INT + b::INT + c::INT + (b and d)::INT as errors, a::INT + b::INT + c::INT + (b and d)::INT + e::INT as serious,
  array_to_string(list_filter([CASE WHEN a THEN 'missing_product_name' END, CASE WHEN b THEN 'missing_price' END, CASE WHEN c THEN 'price_too_low' END, CASE WHEN d and not subtotal THEN 'missing_sku' END,
    CASE WHEN e THEN 'possible_note_or_total' END, CASE WHEN subtotal THEN 'generic_category_subtotal' END, CASE WHEN b and d THEN 'no_price_no_sku' END], lambda q: q is not null), ',') as issues from v),
y as (select *, greatest(0e0, least(1e0, 3e-1 + 4e-1 * 8e-1 + CASE WHEN price >= 1000 THEN 15e-2 ELSE 0e0 END + CASE WHEN d THEN 0e0 ELSE 1e-1 END + coalesce(match_score * 15e-2, 0e0) - serious * 8e-2)) as conf from x),
z as (select *, CASE WHEN subtotal THEN 'skipped' WHEN a or (b and d) THEN 'rejected' WHEN match_score is not null and conf >= 7e-1 THEN 'matched' WHEN conf < 55e-2 or errors > 0 or serious >= 2 THEN 'review' ELSE 'new' END as status from y),
s as (select *, CASE status WHEN 'rejected' THEN 'failed' WHEN 'skipped' THEN 'skipped' WHEN 'review' THEN 'need_review' ELSE CASE WHEN errors > 0 and conf < 7e-1 THEN 'failed' WHEN conf < 62e-2 THEN 'need_review' ELSE 'auto_approved' END END as final_status from z)"""

QUERIES = {f.__name__: f for f in (catalog_search, supplier_list, bulk_price, price_update_split, price_update_summary, catalog_merge, validate_score, summary_counts)}
ORACLES = {
    "catalog_search": f"with {_P} select id, name, supplier from p where contains(lower(name), 'widget') order by id limit 20",
    "supplier_list": f"with {_P} select supplier, min(id) as first_seen, count(*) as products from p group by 1",
    "bulk_price": f"with {_P} select id, supplier, CASE WHEN supplier = 'Brand#4' THEN floor(cost * 925e-3 + 0.5) ELSE cost END as cost from p",
    "price_update_split": f"{_UPDATE} select * from u",
    "price_update_summary": f"{_UPDATE} select status, count(*) as n from u group by 1",
    "catalog_merge": f"""with {_P}, k as (select *, regexp_replace(lower(name || '-' || supplier), '[^a-z0-9]', '', 'g') as key from p),
o as (select key, min(id) as id, arg_min(name, id) as name, arg_min(supplier, id) as supplier, arg_min(cost, id) as cost from k where size <= 30 group by 1),
n as (select key, max(id) as id, upper(arg_max(name, id)) as name, arg_max(supplier, id) as supplier, arg_max(cost + 1, id) filter (size % 2 = 1) as cost from k where size > 20 group by 1)
select coalesce(o.key, n.key) as key, coalesce(o.id, n.id) as id, CASE WHEN o.id is null THEN n.name ELSE o.name END as name, coalesce(n.cost, o.cost) as cost, coalesce(n.supplier, o.supplier) as supplier,
  CASE WHEN o.id is null THEN 'added' WHEN n.id is null THEN 'kept' ELSE 'updated' END as action from o full join n on o.key = n.key""",
    "validate_score": f"{_SCORED} select id, issues, floor(conf * 100 + 0.5) / 100 as confidence, status, final_status from s",
    "summary_counts": f"""{_SCORED} select count(*) as total, count(*) filter (final_status = 'auto_approved') as auto_approved, count(*) filter (final_status = 'need_review') as need_review,
  count(*) filter (final_status = 'failed') as failed, count(*) filter (final_status = 'skipped') as skipped, count(*) filter (status = 'matched') as matched,
  floor(coalesce(avg(conf) filter (final_status <> 'skipped'), 0e0) * 100 + 0.5) / 100 as confidence from s""",
}

"""Queries over priced quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.money import half_up, round_thousand

MARKUP, LABOUR = 1.6, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has: a file of a few MB is one split, however much work its rows are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def priced_lines(spark: SparkSession, sf_dir: str, markup: float = MARKUP) -> DataFrame:
    """Quote lines with their product's sale price; lines whose product is missing are dropped."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    price = round_thousand(F.col("p_retailprice") * F.lit(1000.0) * F.lit(markup)).cast("double")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("amount", price * F.col("l_quantity"))


def quote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = priced_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("amount").alias("device_total"), F.sum("l_quantity").alias("qty_total"))
    labour = half_up(F.col("device_total") * LABOUR / 100).cast("double")
    return per.select(
        F.col("l_orderkey").alias("quote_id"), "device_total", "qty_total", labour.alias("labour"), (F.col("device_total") + labour).alias("grand_total")
    )


def quote_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section subtotals of each quote, its total (section null) and the grand total; lines are summed by section first."""
    sections = priced_lines(spark, sf_dir).groupBy("l_orderkey", "l_returnflag").agg(F.sum("amount").alias("a"), F.sum("l_quantity").alias("q"))
    rolled = sections.rollup(F.col("l_orderkey").alias("quote_id"), F.col("l_returnflag").alias("section"))
    return rolled.agg(F.sum("a").alias("amount"), F.sum("q").alias("qty"))


def variant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of all lines: each line's product replaced by its type's cheapest, first or dearest product.

    Quantities are summed by type before the variants multiply them.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", round_thousand(F.col("p_retailprice") * 1000).cast("double").alias("cost"))
    pick = lambda name, best: F.struct(F.lit(name).alias("variant"), best.alias("cost"))
    choices = part.groupBy("p_type").agg(F.min("cost").alias("low"), F.max("cost").alias("high"), F.min(F.struct("p_partkey", "cost")).alias("first"))
    variants = choices.select("p_type", F.explode(F.array(pick("budget", F.col("low")), pick("standard", F.col("first.cost")), pick("premium", F.col("high")))).alias("v"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    wanted = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    priced = wanted.join(variants, "p_type").select("v.variant", "qty", "n", (F.col("v.cost") * F.col("qty")).alias("spent"), (round_thousand(F.col("v.cost") * MARKUP).cast("double") * F.col("qty")).alias("sold"))
    totals = priced.groupBy("variant").agg(F.sum("sold").alias("device_total"), F.sum("spent").alias("cost_total"), F.sum("qty").alias("qty_total"), F.sum("n").alias("n_lines"))
    labour = half_up(F.col("device_total") * LABOUR / 100).cast("double")
    profit = F.greatest(F.col("device_total") - F.col("cost_total"), F.lit(0.0))
    return totals.select("*", labour.alias("labour"), profit.alias("profit"), half_up(profit / F.col("device_total") * 100).cast("long").alias("margin_percent"))


def scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product type's lines, quantity, suppliers and dearest brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    by_brand = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    top = F.max_by("p_brand", F.struct("qty", "p_brand"))
    return by_brand.groupBy("p_type").agg(F.sum("n").alias("line_count"), F.sum("qty").alias("qty_total"), F.count("*").alias("suppliers"), top.alias("top_supplier"))


def takeoff_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote's quantities by section as one text, sections in order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("qty"))
    noted = F.array_sort(F.collect_list(F.concat("l_returnflag", F.lit(": "), "qty")))  # as many as there are sections
    return lines.groupBy("l_orderkey").agg(F.sum("qty").alias("qty"), F.array_join(noted, "; ").alias("note"))


QUERIES = {f.__name__: f for f in (quote_totals, quote_rollup, variant_totals, scope_summary, takeoff_notes)}
ORACLES = {
    "quote_totals": f"""
with l as (
  select l_orderkey, l_quantity, floor(p_retailprice * 1000.0 * CAST({MARKUP} AS DOUBLE) / 1000 + 0.5) * 1000 * l_quantity as amount
  from lineitem join part on l_partkey = p_partkey),
q as (select l_orderkey, sum(amount) as d, sum(l_quantity) as n from l group by 1)
select l_orderkey as quote_id, d as device_total, n as qty_total, floor(d * {LABOUR} / 100 + 0.5) as labour, d + floor(d * {LABOUR} / 100 + 0.5) as grand_total from q
""",
    "quote_rollup": f"""
with l as (
  select l_orderkey as quote_id, l_returnflag as section, l_quantity, floor(p_retailprice * 1000.0 * CAST({MARKUP} AS DOUBLE) / 1000 + 0.5) * 1000 * l_quantity as amount
  from lineitem join part on l_partkey = p_partkey)
select quote_id, section, sum(amount) as amount, sum(l_quantity) as qty from l group by rollup (quote_id, section)
""",
    "variant_totals": f"""
with p as (select p_partkey, p_type, floor(p_retailprice * 1000.0::DOUBLE / 1000 + 0.5) * 1000 as cost from part),
c as (select p_type, min(cost) as budget, arg_min(cost, p_partkey) as standard, max(cost) as premium from p group by 1),
v as (unpivot c on budget, standard, premium into name variant value cost),
l as (select p_type, l_quantity as q from lineitem join p on l_partkey = p_partkey),
t as (select variant, sum(floor(cost * CAST({MARKUP} AS DOUBLE) / 1000 + 0.5) * 1000 * q) as device_total, sum(cost * q) as cost_total, sum(q) as qty_total, count(*) as n_lines from l join v using (p_type) group by 1)
select *, floor(device_total * {LABOUR} / 100 + 0.5) as labour, greatest(device_total - cost_total, 0) as profit, CAST(floor(greatest(device_total - cost_total, 0) / device_total * 100 + 0.5) AS BIGINT) as margin_percent from t
""",
    "scope_summary": """
with b as (select p_type, p_brand, sum(l_quantity) as qty, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2)
select p_type, CAST(sum(n) AS BIGINT) as line_count, sum(qty) as qty_total, count(*) as suppliers, arg_max(p_brand, (qty, p_brand)) as top_supplier from b group by 1
""",
    "takeoff_notes": """
with s as (select l_orderkey, l_returnflag, CAST(sum(l_quantity) AS BIGINT) as qty from lineitem group by 1, 2)
select l_orderkey, CAST(sum(qty) AS BIGINT) as qty, string_agg(l_returnflag || ': ' || qty, '; ' order by l_returnflag || ': ' || qty) as note from s group by 1
""",
}

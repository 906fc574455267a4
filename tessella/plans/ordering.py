"""Queries with ordered operators: fills, regions, dedupe policies, look-ahead, newest rows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import match_key
from tessella.operators import ordered
from tessella.plans.quoting import table


def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    filled = ordered.forward_fill(turns, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.md5("text")), "section")
    return filled.select("conv_id", "turn", F.coalesce("section", F.lit("")).alias("section"))


def turn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.regions(turns, ["conv_id"], "turn", F.col("role") == "assistant", F.col("role") == "user")


def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return ordered.last_wins(part, match_key(F.concat("p_name", "p_brand")), "p_partkey", ["p_name", "p_brand", "p_retailprice"])


def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    quality = F.when(F.col("p_size") > 25, 2).otherwise(0) + F.when(F.col("p_type") == "PROMO", 1).otherwise(0)
    return ordered.best_wins(part, match_key(F.col("p_name")), quality, "p_partkey", ["p_partkey", "p_brand"])


def lookahead_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ahead = [F.lead(F.when(F.col("event_type") == "purchase", F.col("value")), k).over(order) for k in (1, 2, 3)]
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.coalesce(*ahead).alias("next_price"))
    return events.where("event_type = 'view'").select("event_id", "user_id", "next_price")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ordered.newest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


def quota_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))


def split_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    small, promo = part.where("p_size <= 20").select("p_brand", "p_type"), part.where("p_type = 'PROMO'").select("p_brand", "p_type")
    named = lambda df, name: df.withColumn("part", F.lit(name))
    return named(small.union(promo).distinct(), "union").unionByName(named(small.exceptAll(promo).distinct(), "except")).unionByName(named(small.intersect(promo), "intersect"))


QUERIES = {f.__name__: f for f in (section_ffill, turn_regions, dedupe_last, dedupe_best, lookahead_price, newest_events, quota_month, split_union_except)}
ORACLES = {
    "section_ffill": """select conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN md5(text) END ignore nulls)
  over (partition by conv_id order by turn rows between unbounded preceding and current row), '') as section from conversations""",
    "turn_regions": """with n as (select *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) over (partition by conv_id order by turn rows unbounded preceding) as island from conversations)
select conv_id, min(turn) as first_row, max(turn) as last_row, count(*) as n_items from n where role = 'assistant' group by conv_id, island""",
    "dedupe_last": """with k as (select *, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]', '', 'g') as key from part)
select min(p_partkey) as place, arg_max(p_name, p_partkey) as p_name, arg_max(p_brand, p_partkey) as p_brand, arg_max(p_retailprice, p_partkey) as p_retailprice from k group by key""",
    "dedupe_best": """with k as (select *, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as key, CASE WHEN p_size > 25 THEN 2 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END as quality from part)
select key, quality, p_partkey, p_brand from k qualify row_number() over (partition by key order by quality desc, p_partkey) = 1""",
    "lookahead_price": """with e as (select *, CASE WHEN event_type = 'purchase' THEN value END as v from events),
l as (select event_id, user_id, event_type, coalesce(lead(v, 1) over w, lead(v, 2) over w, lead(v, 3) over w) as next_price from e window w as (partition by user_id order by ts, event_id))
select event_id, user_id, next_price from l where event_type = 'view'""",
    "newest_events": """with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) select * from r where rank <= 3""",
    "quota_month": "select strftime(ts, '%Y-%m') as month, count(*) as used from events group by 1",
    "split_union_except": """with s as (select p_brand, p_type from part where p_size <= 20), p as (select p_brand, p_type from part where p_type = 'PROMO')
select *, 'union' as part from (select * from s union select * from p) union all
select *, 'except' as part from (select distinct * from (select * from s except all select * from p)) union all select *, 'intersect' as part from (select * from s intersect select * from p)""",
}

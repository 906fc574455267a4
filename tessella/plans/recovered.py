"""Queries over what is recovered from pages and answers: lines of glyph runs, objects of cut-off JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import glyphs
from tessella.plans.quoting import table
from tessella.sources import json_salvage

PIECE = "concat('{\"name\":\"', p_name, ' {', p_brand, '}\",\"n\":', p_partkey, '}')"
CUT, TOGETHER = 137, 8


def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders out of three runs of glyphs a line, whose heights differ a little and which stand in another order than they are read."""
    line = table(spark, sf_dir, "lineitem")
    run = lambda j, x, text: f"struct(l_linenumber * 10 + {j} as k, {x}D as x, 700 - 12 * l_linenumber + 0.6D * {j} as y, {text} as str)"
    runs = line.select("l_orderkey", F.inline(F.expr("array({}, {}, {})".format(run(0, 300.26, "l_returnflag"), run(1, 20.0, "concat(' item  ', l_partkey)"), run(2, 100.04, "cast(cast(l_quantity as bigint) as string)")))))
    return glyphs.page_lines(runs, ["l_orderkey"], "k")


def json_salvaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of lists of parts whose ends are cut off at up to 137 characters, braces and quotes inside of names among them."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") / TOGETHER).cast("long").alias("list_id"), "p_partkey", F.expr(PIECE).alias("piece"))
    lists = part.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "piece"))).alias("p"))  # eight a list
    raw = F.concat(F.lit("```json\n["), F.array_join(F.transform("p", lambda x: x["piece"]), ", "), F.lit("]"))
    cut = lists.select("list_id", F.substr(raw, F.lit(1), F.length(raw) - F.col("list_id") * 7 % CUT).alias("raw"))
    return cut.select("list_id", F.posexplode(json_salvage.salvaged(F.col("raw"))).alias("place", "object"))


QUERIES = {f.__name__: f for f in (glyph_lines, json_salvaged)}
ORACLES = {
    "glyph_lines": """with l as (select l_orderkey, l_linenumber, string_agg('item ' || l_partkey, ' ' order by CAST(l_partkey AS VARCHAR)) as a, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' ' order by CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) as b, string_agg(l_returnflag, ' ' order by l_returnflag) as c from lineitem group by all)
select l_orderkey, CAST(row_number() over (partition by l_orderkey order by l_linenumber) - 1 AS INTEGER) as line, CAST(700 - 12 * l_linenumber AS DOUBLE) as y, a || ' ' || b || ' ' || c as text from l""",
    "json_salvaged": f"""with p as (select p_partkey // {TOGETHER} as list_id, p_partkey, concat('{{"name":"', p_name, ' {{', p_brand, '}}","n":', p_partkey, '}}') as piece, concat('{{"n":', p_partkey, ',"name":"', p_name, ' {{', p_brand, '}}"}}') as object from part),
e as (select *, sum(length(piece) + 2) over (partition by list_id order by p_partkey) - 2 as upto, sum(length(piece) + 2) over (partition by list_id) - 2 + 1 as total from p)
select list_id, CAST(row_number() over (partition by list_id order by p_partkey) - 1 AS INTEGER) as place, object from e where upto <= total - list_id * 7 % {CUT}""",
}

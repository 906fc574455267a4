"""Views of the catalogue's lines by state, and solutions of takeoff columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import bom_lines as B
from tessella.plans import sql as S
from tessella.plans.quoting import table

LABEL, NAME = S.pick("p_size", ["Chiếu sáng", "", "Hạ tầng mạng", "Camera"]), S.pick("p_partkey", ["Đèn", "Cáp mạng", "Khóa", "ỐNG luồn", "Nhân công"])
KEY = S.pick("p_partkey * 3 + p_size", ["lighting", "infrastructure", "", "camera", "camera"])
STATUS = S.pick("p_partkey", ["ready", "need_review", "ready"])
GROUP = S.pick("p_size", ["", "Công tắc ", "đèn led", "CB", "thông minh", "x", "Mạng/Wifi tầng 1", "rè"])
CATEGORY = S.pick("p_partkey", ["", "Camera", "camera IP", "Module zigbee", "Ổ cắm", "khác", "Rèm"])
_IGNORED, _PRODUCT, _MARKED, _SCOPE = "p_size % 9 = 0", "CASE WHEN p_size % 2 = 0 THEN p_partkey END", "p_partkey % 11 = 0", "p_size % 13 = 0"


def line_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_brand as bill", f"{LABEL} as label", f"{NAME} as name", "p_type as category", f"{KEY} as solution", f"{STATUS} as status", f"{_IGNORED} as ignored", f"{_PRODUCT} as product", f"{_MARKED} as marked", f"{_SCOPE} as scoped")
    lines = part.withColumn("supporting", B.is_supporting(F.col("marked"), F.col("scoped"), F.col("solution"), F.col("label"), F.col("category"), F.col("name")))
    hidden = B.view_counts(lines, "bill")
    return hidden.join(B.view_counts(lines, "bill", True).select("bill", F.col("ready").alias("ready_too"), F.col("all").alias("all_too")), "bill")


def column_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{GROUP} as label", f"{CATEGORY} as category")
    return part.select("p_partkey", B.solution_of(F.col("label"), F.col("category")).alias("solution"))


_FIRST = lambda rules, test: "CASE " + " ".join(f"WHEN {test(S.quoted(k))} THEN {S.quoted(v)}" for k, v in rules) + " END"
_SHOWN = {
    "core": "not ig and not su", "supporting": "not ig and su", "ready": "not ig and st = 'ready' and not su", "review": "not ig and st = 'need_review' and not su", "matched": "not ig and pr is not null and not su",
    "unresolved": "not ig and pr is null and not su", "ignored": "ig", "all": "ig or not su", "ready_too": "not ig and st = 'ready'", "all_too": "true",
}

QUERIES = {f.__name__: f for f in (line_views, column_solutions)}
ORACLES = {
    "line_views": f"""with l as (select p_brand as bill, {_IGNORED} as ig, {_PRODUCT} as pr, {STATUS} as st, {_MARKED} or {_SCOPE} or {KEY} = 'infrastructure'
  or regexp_matches(lower({LABEL} || ' ' || p_type || ' ' || {NAME}), '{B.SUPPORTING_WORDS}') as su from part)
select bill, {', '.join(f'count(*) filter ({x}) as "{m}"' for m, x in _SHOWN.items())} from l group by 1""",
    "column_solutions": f"""with p as (select p_partkey, lower(trim({GROUP})) as g, {CATEGORY} as c from part)
select p_partkey, coalesce(CASE WHEN g <> '' THEN coalesce({_FIRST(B.GROUPS, lambda k: f'g = {k}')}, {_FIRST(B.GROUPS, lambda k: f'(contains(g, {k}) or contains({k}, g))')}) END,
  {_FIRST(B.CATEGORIES, lambda k: f'c = {k}')}, {_FIRST(B.CATEGORIES, lambda k: f'contains(lower(c), lower({k}))')}, {S.quoted(B.LIGHT)}) as solution from p""",
}

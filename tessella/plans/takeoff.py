"""Takeoff tables as lines, and their devices as catalogue products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import bom as B
from tessella.operators import takeoff as T
from tessella.plans import sql as S
from tessella.plans.quoting import table

# The second row has groups, the third devices; a fourth of the sheets has no header, another no title.
FIRST = S.pick("p_size", ["Tầng 1", "Phòng khách", "", "Tổng", "Sân vườn", "Tầng 2"])
_CELL = lambda k: S.pick(f"p_partkey + {k} * p_size", ["", "2", "0", "5 bộ", "x", "12"])
_KIND = "length(p_name) % 4"
GROUPS = f"CASE WHEN {_KIND} = 3 THEN 'Mục' ELSE ' Phòng' END, 'Công tắc', '', 'Cảm biến', '', '', 'Camera ngoài trời', ''"
DEVICES = "'', '1 nút', 'Công tắc 2 nút', 'chuyển động', 'Cảm biến hiện diện', '1 nút', '', 'Đầu ghi'"
FLOOR = f"{FIRST}, {', '.join(_CELL(k) for k in range(1, 8))}"
TITLE = f"CASE WHEN {_KIND} = 2 THEN '' ELSE p_name END"
# The header's kind is that of its own row.
_TEXT = "CASE row_number() over (partition by p_brand order by p_partkey) WHEN 1 THEN {0}{2}{1} WHEN 2 THEN {0}{3}{1} WHEN 3 THEN {0}{4}{1} ELSE {0}{5}{1} END"
LABELS = [
    "1 nút", "Công tắc 2 nút", "CBCĐ", "Camera ngoài", "Đầu ghi NVR", "Switch PoE 1000", "Switch 16 cổng", "Wifi gắn tường", "Wifi", "Ổ cắm", "Rèm", "loa âm trần", "Trung tâm", "abc", "Motor", "đèn 7w", "widget", "không có",
]
NAMES = [
    "Công tắc Luto 1 nút", "Luto 2", "Cảm biến PIR", "Cảm biến chuyển động", "Camera trong nhà", "Switch 1000M", "Bộ phát wifi", "Ổ cắm âm sàn", "Động cơ rèm", "Loa âm trần 6W", "Bộ điều khiển trung tâm", "Đèn 7W trắng", "Cổng motor", "Đầu thu",
]
NAME, SKU = S.pick("p_partkey", NAMES), S.pick("p_size", ["DS-7616", "DS-2CD1047G", "ABC", "wifi-gan-tuong", "DS-3E1318", ""])


def takeoff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_brand as sheet", "p_partkey as idx", _TEXT.format("array(", ")", TITLE, GROUPS, DEVICES, FLOOR) + " as text")
    lines = T.takeoff_lines(rows).withColumn("raw", T.line_name(F.col("grp"), F.col("label")))
    lines = lines.withColumn("model", B.model_of(F.col("raw"))).withColumn("name", F.coalesce(F.nullif(B.bare_name(F.col("raw"), F.col("model")), F.lit("")), "raw"))
    return lines.withColumn("skipped", ~B.product_like(F.col("name")) & (F.col("model") == "")).drop("model", "raw")


def device_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    products = table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{NAME} || ' ' || p_name as name", f"{SKU} as sku")
    return T.device_products(labels, products)


_any = lambda x, words: "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"
_SQL_ROWS = "p_brand as sheet, p_partkey as idx, " + _TEXT.format("[", "]", TITLE, GROUPS, DEVICES, FLOOR) + " as t"
_CHOICES = ", ".join(f"({i}, {k}, '{field}', [{', '.join(map(S.quoted, words))}])" for i, (_, found) in enumerate(T.DEVICES) for k, (field, *words) in enumerate(found))
_LIKE = f"(length(n) >= 4 and not {_any('n', B.NO_PRODUCT)} and n not in ({', '.join(map(S.quoted, B.EMPTY_NAMES))}) and ({_any('n', B.TECHNICAL)} or (len(string_split(n, ' ')) >= 2 and length(n) >= 8)))"

QUERIES = {f.__name__: f for f in (takeoff_lines, device_products)}
ORACLES = {
    "takeoff_lines": f"""with raw as (select {_SQL_ROWS} from part), r as (select *, row_number() over (partition by sheet order by idx) as r, trim(coalesce(t[1], '')) as a from raw),
h as (select sheet, min(r) as h from r where r <= 6 and lower(a) in ('tầng', 'khu vực', 'phòng') group by 1),
m as (select r.*, h.h, trim(array_to_string(list_filter(t, lambda c: coalesce(c, '') <> ''), ' ')) as whole from r join h using (sheet)),
title as (select sheet, arg_min(whole, r) as title from m where r < h and whole <> '' group by 1),
g as (select sheet, unnest(range(len(t))) as col, trim(unnest(t)) as g from m where r = h), s as (select sheet, unnest(range(len(t))) as col, trim(unnest(t)) as s from m where r = h + 1),
d as (select sheet, col, s, coalesce(last_value(nullif(g, '') ignore nulls) over (partition by sheet order by col rows between unbounded preceding and current row), '') as grp from g join s using (sheet, col) where col > 0),
e as (select sheet, col, CASE WHEN s <> '' THEN s ELSE grp END as label, grp from d), k as (select *, first_value(grp) over w as g0, min(col) over (partition by sheet, label) as c0 from e where label <> '' window w as (partition by sheet, label order by col)),
f as (select sheet, idx, a as area, unnest(range(len(t))) as col, unnest(t) as x from m where r > h + 1 and a <> '' and lower(a) not in ('tổng', 'tong')),
l as (select sheet, idx, area, label, any_value(g0) as grp, any_value(c0) as col, arg_max(n, col) as qty from (select f.*, label, g0, c0, TRY_CAST(nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') as BIGINT) as n from f join k using (sheet, col)) where n > 0 group by 1, 2, 3, 4),
y as (select l.*, (select count(distinct idx) from l q where q.sheet = l.sheet) as floors, (select count(*) from l q where q.sheet = l.sheet and q.label = l.label) as having_it, {S.flat('grp')} as a, {S.flat('label')} as b from l),
z as (select *, {S.plain('a')} as pa, {S.plain('b')} as pb from y),
w as (select *, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN contains(pb, pa) or contains(pa, pb) THEN CASE WHEN length(b) >= length(a) THEN b ELSE a END ELSE a || ' ' || b END as name from z),
v as (select *, {S.plain('name')} as n from w)
select v.sheet, idx, area, coalesce(title, '') as title, CAST(col AS INTEGER) as col, grp, label, qty, having_it = 1 and floors > 1 as shared, (select count(*) from k where k.sheet = v.sheet) >= 2 as as_matrix, name, not {_LIKE} as skipped from v left join title using (sheet)""",
    "device_products": f"""with p as (select p_partkey as id, lower({NAME} || ' ' || p_name) as name, lower({SKU}) as sku from part), l(label) as (values {', '.join(f'({S.quoted(x)})' for x in LABELS)}),
c(device, choice, field, words) as (values {_CHOICES}), f as (select device, choice, min(id) as id from c, p where len(list_filter(words, lambda w: contains(CASE field WHEN 'code' THEN sku ELSE name || ' ' || sku END, w))) = len(words) group by 1, 2),
b as (select device, arg_min(id, choice) as id from f group by 1), d as (select label, lower(label) as c, CASE {' '.join(f"WHEN regexp_matches(lower(label), {S.quoted(x)}) THEN {i}" for i, (x, _) in enumerate(T.DEVICES))} END as device from l)
select label, coalesce(b.id, (select min(p.id) from p where d.device is null and length(d.c) > 4 and contains(p.name, d.c))) as product from d left join b using (device)""",
}

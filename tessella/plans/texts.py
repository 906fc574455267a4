"""Queries over texts and pages: keys, prices, codes, HTML, JSON, header rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import products as P
from tessella.functions import text as T
from tessella.operators import structure
from tessella.plans.quoting import table
from tessella.sources import html as H


def fold_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.match_key(F.col("text"))).alias("match_key"), F.md5(T.learning_key(F.col("text"))).alias("learning_key"))


def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    whole = F.concat_ws("::", "p_name", "p_brand", "p_type")
    return part.select("p_partkey", F.concat(F.lit("tpl_"), T.fnv1a(whole)).alias("template_id"), T.slug(F.col("p_name")).alias("slug"), T.sku_key(F.col("p_brand")).alias("sku_key"))


def price_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", P.price_candidates(F.col("text")).alias("p"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("p").cast("long").alias("n_prices"), F.coalesce(F.get("p", F.lit(0)), F.lit(0)).cast("long").alias("lowest"), total.alias("total"))


LABEL = "{0}p_name, ' SBX', p_partkey, '-', p_size, 'C / ', upper(substr(p_type, 1, 3)), p_partkey, '|model ', replace(p_brand, '#', '-'), ' ', p_partkey * 1000)"


def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(LABEL.format("concat(")).alias("label"))
    return part.select("p_partkey", F.array_join(P.code_candidates(F.col("label")), ",").alias("codes"), P.best_code(F.col("label")).alias("best"), P.safe_price(F.col("label")).alias("price"))


def document_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", P.code_candidates(F.col("text")).alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("n_codes"), F.array_join("c", ",").alias("codes"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", H.links(F.col("html")).alias("l"))
    outer = F.size(F.filter("l", lambda x: x.startswith("http")))
    return pages.select("page_id", F.size("l").cast("long").alias("n_links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"), outer.cast("long").alias("n_absolute"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


HEADERS = [
    ("a", 0, ["Công ty ABC", "", "2024"]), ("a", 1, ["STT", "Tên thiết bị", "Model", "ĐVT", "Số lượng", "Đơn giá"]), ("a", 2, ["1", "Đèn", "LM-S4", "cái", "2", "1.200.000"]),
    ("b", 0, ["no", "code", "price", "qty"]), ("b", 1, ["No", "Code", "Price", "Qty", "Image"]), ("b", 2, ["1", "2", "3", "4"]), ("c", 0, ["x", "y"]),
]


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.detect_header(spark.createDataFrame(HEADERS, "sheet string, idx int, text array<string>"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = ("p_name", "p_brand", "p_type", "p_size")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("cell")) for c in names))
    cells = part.select(F.explode(pairs).alias("x")).select("x.*")
    return structure.profile(cells, "field", "cell")


_FOLD = "replace(strip_accents(lower(coalesce({0}, ''))), 'đ', 'd')"
_PRICES = (
    "list_sort(list_filter(list_transform(list_concat(regexp_extract_all(coalesce({0}, ''), '[0-9]{{1,3}}(?:[.,][0-9]{{3}}){{1,4}}'), regexp_extract_all(coalesce({0}, ''), '\\b[0-9]{{5,10}}\\b')), "
    "lambda x: CAST(regexp_replace(x, '[.,]', '', 'g') AS BIGINT)), lambda n: n between 1000 and 1000000000))"
)
_CODE = r"\b(?:[A-Z]{2,}[A-Z0-9]*[-_/][A-Z0-9][A-Z0-9._\-/]{1,}|[A-Z]{2,}[0-9]{2,}[A-Z0-9._\-/]*|[A-Z0-9]{2,}-[A-Z0-9]{2,}(?:[-_/][A-Z0-9]{1,})*)\b"


def _codes(x: str) -> str:
    plain = f"regexp_replace(upper(coalesce({x}, '')), '[ \t\r\n|]+', ' ', 'g')"
    trimmed = rf"list_transform(regexp_extract_all({plain}, '{_CODE}'), lambda c: regexp_replace(c, '^[^A-Z0-9]+|[^A-Z0-9._\-/]+$', '', 'g'))"
    good = f"list_filter({trimmed}, lambda c: not regexp_matches(c, '{P.NO_CODES}') and length(c) between 4 and 40 and regexp_matches(c, '[A-Z]') and regexp_matches(c, '[0-9]'))"
    return good


_RANKED = """
codes as (select id, unnest(c) as code, generate_subscripts(c, 1) as place from found),
firsts as (select id, code, min(place) as place from codes group by 1, 2),
listed as (select id, string_agg(code, ',' order by place) as codes, count(*) as n from firsts group by 1)"""

QUERIES = {f.__name__: f for f in (fold_keys, name_hashes, price_candidates, code_candidates, document_codes, page_titles, page_links, page_text, json_fields, header_rows, column_profile)}
ORACLES = {
    "fold_keys": f"""select doc_id, md5(regexp_replace({_FOLD.format('text')}, '[^a-z0-9]', '', 'g')) as match_key,
  md5(trim(regexp_replace({_FOLD.format('text')}, '[^a-z0-9]+', ' ', 'g'))) as learning_key from documents""",
    "name_hashes": f"""with s as (select *, p_name || '::' || p_brand || '::' || p_type as whole from part)
select p_partkey, 'tpl_' || lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(whole) + 1), lambda i: ord(substr(whole, i, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) as template_id,
  substr(regexp_replace(regexp_replace({_FOLD.format('p_name')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) as slug,
  regexp_replace(lower(p_brand), '[\\s\\-/._]', '', 'g') as sku_key from s""",
    "price_candidates": f"""with d as (select doc_id, {_PRICES.format('text')} as p from documents)
select doc_id, CAST(len(p) AS BIGINT) as n_prices, CAST(coalesce(p[1], 0) AS BIGINT) as lowest, CAST(coalesce(list_sum(p), 0) AS BIGINT) as total from d""",
    "code_candidates": f"""with l as (select p_partkey as id, {LABEL.format('concat(')} as label from part), found as (select id, {_codes('label')} as c from l), {_RANKED},
best as (select id, arg_max(code, (CASE WHEN regexp_matches(code, '[-_/]') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(code, '^[A-Z]{{2,}}[-_/]') THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(code, '^[A-Z]{{2,}}[0-9]') THEN 2 ELSE 0 END + CASE WHEN length(code) between 6 and 22 THEN 2 ELSE 0 END - CASE WHEN length(code) > 28 THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(code, '{P.KNOWN_CODES}') THEN 2 ELSE 0 END) * 1000000 - length(code) * 1000 - place) as best from firsts group by 1),
prices as (select id, {_PRICES.format('label')} as p from l)
select l.id as p_partkey, coalesce(codes, '') as codes, coalesce(best, '') as best, CAST(coalesce(p[1], 0) AS BIGINT) as price
from l left join listed using (id) left join best using (id) join prices using (id)""",
    "document_codes": f"""with found as (select doc_id as id, {_codes('text')} as c from documents), {_RANKED}
select found.id as doc_id, coalesce(n, 0) as n_codes, coalesce(codes, '') as codes from found left join listed using (id)""",
    "page_titles": r"""with p as (select page_id,
  trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')) as h, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')) as t from pages)
select page_id, replace(replace(replace(replace(replace(replace(coalesce(nullif(h, ''), t), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as title from p""",
    "page_links": """with p as (select page_id, regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1) as l from pages)
select page_id, CAST(len(l) AS BIGINT) as n_links, CAST(len(list_distinct(l)) AS BIGINT) as n_distinct, CAST(len(list_filter(l, lambda x: starts_with(x, 'http'))) AS BIGINT) as n_absolute from p""",
    "page_text": r"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'),
  '(?i)<br[^>]*>|</(?:p|div|li|h[1-6]|tr|section|article)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') as x from pages),
b as (select page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as x from a),
c as (select page_id, trim(regexp_replace(regexp_replace(x, '[ \t\r\f\x{00a0}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) as t from b)
select page_id, length(t) as n_chars, md5(t) as digest from c""",
    "json_fields": """with e as (select event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) as k from events)
select event_type, count(k) as n, CAST(sum(k) AS BIGINT) as total, min(k) as low, max(k) as high from e group by 1""",
    "header_rows": structure.header_oracle(HEADERS),
    "column_profile": " union all ".join(
        f"""select '{c}' as field, count(*) as total, avg(CASE WHEN regexp_matches(x, '^[0-9.,\\s]+$') THEN 1.0::DOUBLE ELSE 0 END) as numeric_ratio,
  avg(CASE WHEN regexp_matches(x, '[A-Za-z]') and regexp_matches(x, '[0-9]') and length(x) <= 30 THEN 1.0::DOUBLE ELSE 0 END) as code_ratio,
  avg(CASE WHEN length(x) > 40 THEN 1.0::DOUBLE ELSE 0 END) as long_ratio, avg(length(x)) as avg_len from (select trim({c}::VARCHAR) as x from part) where x <> ''"""
        for c in ("p_name", "p_brand", "p_type", "p_size")
    ),
}

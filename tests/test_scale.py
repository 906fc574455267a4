"""Operators whose cost once grew faster than their input."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import web as W
from tessella.operators import chunks as K
from tessella.operators import imports as I
from tessella.operators import ranking as R
from tessella.plans import assembly, bom, composition, imports, items, web


def plan_size(df):
    return df._jdf.queryExecution().analyzed().toString().__len__()


def test_header_steps_grow_with_the_fields_not_twofold_each(spark):
    headers = spark.createDataFrame([(1, ["b a", None, "a", "c b", "a"]), (2, None), (3, ["x", "c", "C"]), (4, ["b a", None, "a", "c b", "a"])], "sheet long, text array<string>")
    got = {r[0]: tuple(r)[1:] for r in I.catalog_columns(headers, [("a", "a"), ("b", "b"), ("c", "c")]).collect()}
    assert got == {1: (0, 3, None), 2: (None, None, None), 3: (None, None, 1), 4: (0, 3, None)}
    size = [plan_size(I.catalog_columns(headers, I.CATALOG_FIELDS[:n])) for n in (5, 10)]
    assert size[1] < 3 * size[0]


def test_digits_of_a_code_are_no_price(spark):
    texts = [("hot bolt K10024", None), ("bolt K120000 560.137 đ", 560137), ("K1.234.567", None), ("VND10000", 10000), ("Giá10000", 10000), ("K10000 đ", 10000), ("S4-10000", 10000)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    assert [r["v"] for r in rows.select("i", W.first_price(F.col("t"))["value"].alias("v")).orderBy("i").collect()] == [v for _, v in texts]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_compositions_deal_lines_by_quote_once(spark):
    assert exchanges(composition.composed_variants(spark, "/root/testdata/sf0.001")) <= 60


def dealt(spark, query):
    """Shuffles that a query writes, without those that are read again, and with no table small enough to be sent around."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]


def test_composed_variants_deals_lines_once_and_looks_products_up_once(spark):
    """Lines by quote, products asked for by product and back by quote, products, the templates' few products."""
    found = dealt(spark, composition.composed_variants)
    assert len(found) == 5, found


def test_variant_rooms_deals_lines_once(spark):
    """A condition on one use of the lines doesn't make it a shuffle of its own."""
    found = dealt(spark, composition.variant_rooms)
    assert len(found) == 5, found


def test_template_lines_deals_lines_once_and_not_the_templates_candidates(spark):
    """Candidates are a dozen rows a quote and twenty products in all: none goes to its product."""
    found = dealt(spark, composition.template_lines)
    assert len(found) == 5 and not any("scope" in x or "component" in x for x in found), found


def test_choices_shuffle_a_line_not_its_variants(spark):
    """Candidates are counted once whatever the number of variants."""
    found = imports.variant_choices(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Aggregate [")


def test_chunks_of_a_page_of_many_blocks(spark, monkeypatch):
    """Blocks of four lines, pages of many; no page is one row's array."""
    monkeypatch.setattr(K, "BLOCK_BITS", 2)
    lines = [("f", page, n, "x" * ((n * 37 + page) % 29 + 1 if n % 13 else 0)) for page in (1, 2) for n in range(90)] + [(None, 1, 0, "y" * 70), (None, 1, 1, "z")]
    want, at = [], {}
    for file, page, _, line in lines:
        if not line:
            continue
        open_ = want[-1] if want and want[-1][:2] == (file, page) else None
        if open_ is None or len(open_[3]) >= 8 or sum(len(t) + 1 for t in open_[3]) + len(line) + 1 > 60:
            at[file] = at.get(file, 0) + 1
            open_ = (file, page, at[file], [])
            want.append(open_)
        open_[3].append(line)
    rows = spark.createDataFrame(lines, "file string, page int, n int, line string").repartition(7)
    found = K.chunk_lines(rows, 60, 8)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr((f, p, c, "\n".join(t), len(t))) for f, p, c, t in want)


@pytest.mark.parametrize("query", [imports.file_suppliers, bom.bom_lines, web.product_images, assembly.sanitised_products, items.sheet_items])
def test_heavy_rows_are_dealt_before_their_work(spark, query):
    """A file of one split doesn't leave all work to one task."""
    assert "Exchange hashpartitioning(p_partkey" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def plain_ranking(lines, products, learned, k):
    """All pairs, scored one by one."""
    words = lambda *t: {w for w in re.split("[^a-z0-9]+", " ".join(t).lower()) if len(w) >= 2 and w not in R.STOP_WORDS}
    out = []
    for line, model, *rest in lines:
        found, m = [], model.lower()
        for product, *texts in products:
            sku, _, category, _ = (t.lower() for t in texts)
            text = f"{texts[1]} {texts[0]} {texts[2]} {texts[3]}".lower()
            a, b = words(rest[0], model, *rest[1:]), words(*texts)
            near = len(a & b) / max(min(len(a), len(b)), 1) * 0.78 + (0.1 if m and m[:6] in text else 0.0) + (0.08 if rest[1] and category and rest[1].lower()[:5] in category else 0.0)
            inside = m and sku and (m in sku or sku in m) and min(len(m), len(sku)) >= 4
            score = 0.98 if m and m == sku else 0.9 if inside else 0.84 if len(m) >= 4 and m in text else min(0.82, near)
            if (line, product) in learned:
                found.append((False, -1.0, product))
            elif score >= R.LEAST:
                found.append((True, -score, product))
        out += [(line, p, math.floor(-s * 100 + 0.5) / 100, not open_, i + 1) for i, (open_, s, p) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_ranking_of_classes_equals_all_pairs(spark):
    rng = random.Random(11)
    some = lambda of, n: " ".join(rng.choice(of) for _ in range(rng.randrange(n + 1)))
    nouns, codes = ["pump", "valve", "ring", "gear", "bo", "xa"], ["", "x", "ab", "pump", "gear-1", "gear-12", "gear-123-z", "valve-4", "b-1"]
    lines = [(i, rng.choice(codes), some(nouns, 3), rng.choice(["", "Pump", "gears", "valve set"]), some(nouns, 1)) for i in range(150)]
    products = [(i, rng.choice(codes), some(nouns, 3), rng.choice(["", "PUMPS", "gears", "valve set"]), some(["acme", "gear", "x"], 1)) for i in range(200)]
    learned = {(i, rng.randrange(200)) for i in range(0, 150, 3)}
    frames = [spark.createDataFrame(lines, "line long, model string, name string, category string, note string"), spark.createDataFrame(products, "product long, sku string, name string, category string, supplier string")]
    got = R.rank(*frames, spark.createDataFrame(sorted(learned), "line long, product long"), 3)
    assert sorted((r.line, r["product"], r.score, r.learned, r["rank"]) for r in got.collect()) == plain_ranking(lines, products, learned, 3)


def test_ranking_pairs_classes_not_products(spark, monkeypatch):
    """A thousand products that differ in a word no line has are one class: a line meets it, not each of them."""
    staged = []
    monkeypatch.setattr(R, "kept", lambda rows: staged.append(rows) or rows)
    lines = spark.createDataFrame([(i, "", "pump", "", f"n{i % 2}0") for i in range(40)], "line long, model string, name string, category string, note string")
    products = spark.range(1000).selectExpr("id as product", "concat('q', id) as sku", "'pump' as name", "'' as category", "'' as supplier")
    found = R.rank(lines, products, lines.selectExpr("line", "0L as product").where("false"))
    assert [r["product"] for r in found.where("line = 7").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert [rows.select(f"{name}_class").distinct().count() for rows, name in zip(staged[2:4], ("line", "product"), strict=True)] == [1, 1]

"""Functions and operators on literals, nulls, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import inference, money, products, text
from tessella.operators import catalog, matching, ordered, scoring


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (text.fold, "Công tắc Đèn", "Cong tac Den"), (text.match_key, "Công tắc Đèn!", "congtacden"), (text.learning_key, " Ổ cắm -- đôi ", "o cam doi"),
        (text.web_key, "Đèn", "en"), (text.match_key, None, ""), (text.clean_text, "a \n b ", "a b"), (text.sku_key, "LM-S4/A.b", "lms4ab"),
        (text.fnv1a, "abc", "1a47e90b"), (text.slug, "Thiếu giá (VND)", "thieu_gia_vnd"),
        (products.safe_price, "03-05 ngày", 0), (products.safe_price, "39.890.000", 39890000), (products.safe_price, None, 0), (products.safe_price, "x 7200000 và 768.000đ", 768000),
        (products.best_code, "\n\n\nOSN-KBT06", "OSN-KBT06"), (products.best_code, "Mã khóa sử dụng: OSN-3381, OSN-KBT06", "OSN-3381"), (products.best_code, "hotline 0909", ""),
        (products.quantity, "1,000", 1.0), (products.quantity, "2,5 m", 2.5), (products.quantity, "03/05/2024", None), (products.quantity, "0", None), (products.quantity, None, None),
        (money.bulk_percent, "-5,5 %", -5.5), (money.bulk_percent, "abc", None),
    ],
)
def test_literals(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_rounding_of_halves(spark):
    assert [one(spark, v, money.half_up, "double") for v in (-2.5, 2.5, 0.49)] == [-2, 3, 0]


def test_last_wins_keeps_blank_keys(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, None, 2), (2, "a", 3), (3, "", 4)], "pos int, k string, v int")
    got = sorted(tuple(r) for r in ordered.last_wins(rows, F.col("k"), "pos", ["v"]).collect())
    assert got == [(0, 3), (1, 2), (3, 4)]


def test_fuzzy_equals_brute_force(spark):
    words = ["motor", "switch", "sensor", "panel", "hub", "lock", "gate", "lamp"]
    names = [f"{a}{b}{k}" for a in words for b in words for k in ("", "x", "10")]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    dice = lambda a, b: 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))
    items, known = names[::2] + ["", "z"], names[1::2]
    want = {}
    for a in items:
        best = max(((dice(a, b), -i) for i, b in enumerate(known) if grams(a) and dice(a, b) > matching.DICE), default=None)
        if best:
            want[a] = -best[1], round(best[0], 9)
    left = spark.createDataFrame([(a,) for a in items], "key string")
    right = spark.createDataFrame([(b, i) for i, b in enumerate(known)], "key string, product int")
    got = {r["key"]: (r["product"], round(r["score"], 9)) for r in matching.fuzzy_top1(left, right).collect()}
    assert got == want and len(want) > 20


def test_price_update_drops_blank_codes_and_takes_the_last_of_equal_ones(spark):
    known = spark.createDataFrame([(1, "A-1", 10.0), (2, "a-1 ", 20.0), (3, "B", None)], "id int, sku string, cost double")
    feed = spark.createDataFrame([(" a-1", 20.0), ("b", 5.0), ("", 1.0), (None, 1.0), ("c", 7.0)], "sku string, price double")
    got = {r["sku"]: (r["id"], r["status"]) for r in catalog.price_update(known, feed).collect()}
    assert got[" a-1"] == (2, "unchanged") and got["c"] == (None, "new") and len(got) == 3


def test_merge_adds_each_row_without_a_code_and_tells_codes_apart(spark):
    kind = "id int, sku string, name string, cost double, supplier string"
    old = spark.createDataFrame([(1, "LM-1", "a", 10.0, "s"), (2, "LM1", "b", 20.0, "s"), (3, "", "c", 30.0, "s"), (4, None, "d", 40.0, "s")], kind)
    new = spark.createDataFrame([(11, "lm-1", "x", 11.0, None), (12, "", "y", 12.0, "t"), (13, "", "z", 0.0, "t"), (14, None, "w", 14.0, "t"), (15, "N", "n", 15.0, "t"), (16, "n", "m", 0.0, "")], kind)
    got = sorted((r["id"], r["cost"], r["supplier"], r["action"]) for r in catalog.merge(old, new, F.lower(F.col("sku"))).collect())
    kept = [(2, 20.0, "s", "kept"), (3, 30.0, "s", "kept"), (4, 40.0, "s", "kept")]
    assert got == [(1, 11.0, "s", "updated"), *kept, (12, 12.0, "t", "added"), (13, 0.0, "t", "added"), (14, 14.0, "t", "added"), (16, 15.0, "t", "added")]


def test_bulk_percent_refuses_to_go_below_nothing(spark):
    with pytest.raises(ValueError, match="above -100"):
        catalog.bulk_percent(spark.createDataFrame([("a", 1.0)], "supplier string, cost double"), "a", -100)


def test_scores_of_clean_and_empty_items(spark):
    items = [("Đèn", 1_000_000, "LM-1", False, 1.0), ("", None, None, False, None), ("Sản phẩm", 5_000, None, False, None), ("Công tắc", 5_000, None, True, None)]
    df = spark.createDataFrame(items, "name string, price long, sku string, subtotal boolean, match_score double")
    got = [(r["status"], r["final_status"]) for r in scoring.scored(df, 0.8).collect()]
    assert got == [("matched", "auto_approved"), ("rejected", "failed"), ("review", "need_review"), ("skipped", "skipped")]


def test_junk_is_lists_terms_and_long_texts_without_price_or_code(spark):
    items = [("- Đèn", 5.0, "A-1"), ("3) Đèn", 5.0, "A-1"), ("3.5 m Đèn", 0.0, ""), ("BẢO HÀNH 2 năm", 0.0, None), ("Bảo hành 2 năm", 5.0, None), ("x" * 81, None, " "), ("x" * 80, None, " "), (None, None, None)]
    df = spark.createDataFrame(items, "name string, cost double, sku string")
    assert {r["name"] for r in catalog.without_junk(df).collect()} == {"3.5 m Đèn", "Bảo hành 2 năm", "x" * 80, None}


def test_amounts_of_a_price_line(spark):
    lines = ["Cổng âm sàn VULCAN 24V 41.900.000 19.765.000", "Thời gian giao hàng 03-05 ngày", "9.999 10.000 10,000 20000 30000", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = df.orderBy("i").select(products.price_fields(products.money_values(F.col("line"))).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [(19_765_000, 41_900_000, 0), (0, 0, 0), (10_000, 30_000, 20_000), (0, 0, 0), (0, 0, 0)]


def test_domain_of_a_group_takes_the_first_listed_of_equals(spark):
    rows = [("a", 1, "ổ cắm"), ("a", 2, "Camera"), ("b", 1, "xyz"), ("b", 2, None), ("c", 1, "SOFA"), ("c", 2, "bàn")]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    got = {r["g"]: (r["domain"], r["share"]) for r in scoring.detect_domain(df, "g", "i", F.col("t")).collect()}
    assert got == {"a": ("smarthome", 0.5), "b": ("general", 0.0), "c": ("furniture", 1.0)}


def test_roman_numbers_and_their_order(spark):
    df = spark.createDataFrame([(0,), (4,), (9,), (10,), (23,), (None,)], "n int").select("n", inference.roman(F.col("n")).alias("r"))
    got = df.select("r", inference.roman_order(F.concat("r", F.lit(". Đèn"))).alias("place")).collect()
    assert [tuple(r) for r in got[:5]] == [("", 99), ("IV", 4), ("IX", 9), ("X", 10), ("XXIII", 99)]

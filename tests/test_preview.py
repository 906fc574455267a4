"""Previews of imports on literal values."""

from pyspark.sql import functions as F

from tessella.operators import preview as V

ROWS = "file string, sheet string, idx long, text array<string>"


def test_plain_sheets(spark):
    rows = [
        ("a_b-c.xlsx", "s", [["2024", "", "12"], ["", None, ""], ["Tên hàng", "Giá bán", None], ["Đèn", "1.500 đ", "x"], ["", "900", ""], ["Khóa", None, None]]),
        ("a_b-c.xlsx", "no name", [["Mã", "Ghi", "Giá"], ["M1", "một hai ba", "5"], ["M2", "bốn năm sáu", ""], ["", "z", ""]]),
        ("a_b-c.xlsx", "one row", [["Tên", "Giá"]]), ("e", "blank", [[None], [""], []]), ("e", "numbers", [["1", "2"], ["3", "44"]]),
    ]
    df = spark.createDataFrame([(f, s, i, t) for f, s, rs in rows for i, t in enumerate(rs)], ROWS)
    found = {(r.sheet, r.idx): r for r in V.plain_items(df).collect()}
    assert {k: (r.name, r.sku, r.price) for k, r in found.items()} == {
        ("s", 3): ("Đèn", "", 1500.0), ("s", 5): ("Khóa", "", 0.0), ("no name", 1): ("một hai ba", "M1", 5.0), ("no name", 2): ("bốn năm sáu", "M2", 0.0), ("numbers", 1): ("44", "", 0.0),
    }
    first = found["s", 3]
    assert (first.category, first.supplier, first.unit, first.raw) == ("Chung", "a b c", "Cái", "Đèn 1.500 đ x")
    assert V.plain_items(df.limit(0)).count() == 0


def test_cascade_and_empty_files(spark):
    items = lambda rows: spark.createDataFrame(rows, "file string, name string")
    files = spark.createDataFrame([(f,) for f in "abc"], "file string")
    kept, state = V.cascade(files, items([("a", "x")]), items([("a", "old"), ("b", "y"), ("b", "z")]))
    assert sorted(map(tuple, kept.collect())) == [("a", "x"), ("b", "y"), ("b", "z")]
    assert sorted(map(tuple, state.collect())) == [("a", "v2", ""), ("b", "legacy", V.LEGACY), ("c", "v2", V.EMPTY)]
    kept, state = V.cascade(files, items([]), items([]))
    assert kept.count() == 0 and {r.warning for r in state.collect()} == {V.EMPTY}


def test_issues_and_status(spark):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(["Thiếu tên sản phẩm", "Giá lạ!", "???", "Failed to parse"])], "k int, m string").orderBy("k")
    assert [tuple(r.i) for r in df.select(V.text_issue(F.col("m")).alias("i")).collect()] == [("thieu_ten_san_pham", "error"), ("gia_la", "warning"), ("issue", "warning"), ("failed_to_parse", "error")]
    cases = [("rejected", 0.9, []), ("skipped", 0.1, []), ("review", 0.9, []), ("new", 0.65, ["error"]), ("new", 0.75, ["error"]), ("matched", 0.61, ["info"]), (None, 0.62, [])]
    df = spark.createDataFrame([(k, s, c, [("x", v) for v in i]) for k, (s, c, i) in enumerate(cases)], "k int, s string, c double, i array<struct<code:string,level:string>>").orderBy("k")
    got = [r.f for r in df.select(V.final_status(F.col("s"), F.col("c"), F.col("i")).alias("f")).collect()]
    assert got == ["failed", "skipped", "need_review", "failed", "auto_approved", "need_review", "auto_approved"]


def test_lines_of_nulls(spark):
    schema = (
        "file string, sheet string, row long, name string, sku string, category string, supplier string, unit string, cost double, listed double, least double, price_mode string, specs string, raw string,"
        "product long, match_type string, match_score double, confidence double, status string, issues array<struct<code:string,level:string>>, subtotal boolean, line_no int"
    )
    rows = [("f", s, r, *[None] * 11, p, None, None, c, None, None, None, 9) for s, r, p, c in [("s1", 7, None, None), ("s2", 1, 5, 1.5), ("s1", 9, None, -1.0), ("s0", 3, None, 0.7)]]
    lines = V.import_lines(spark.createDataFrame(rows, schema)).orderBy("line_no").collect()
    assert [(r.line_no, r.source.sheet, r.source.row, r.confidence, r.status) for r in lines] == [
        (1, "s0", 3, 0.7, "auto_approved"), (2, "s1", 7, 0.72, "auto_approved"), (3, "s1", 9, 0.0, "need_review"), (4, "s2", 1, 1.0, "auto_approved"),
    ]
    assert len({r.line_id for r in lines}) == 4 and lines[0].matched is None and lines[3].matched.method == "unknown" and lines[0].parsed.unit == "Cái"

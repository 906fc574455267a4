"""Column mapping on small sheets: headers alone, cells alone, nulls, ties."""

from tessella.operators.columns import cell_stats, map_columns


def _mapped(spark, headers, rows):
    heads = spark.createDataFrame(headers, "sheet string, text array<string>")
    cells = spark.createDataFrame(rows, "sheet string, idx int, text array<string>")
    return {r["sheet"]: r for r in map_columns(heads, cells).collect()}


def test_headers_alone(spark):
    got = _mapped(spark, [("a", ["Mã SP", "MÃ HÀNG", "Tên hàng", None, "Đơn giá", "Giá nhập"]), ("b", [None, ""])], [])
    a = got["a"]
    # the lowest column of two that fit; a cost before another price; a name without cells gives way to the code
    assert (a["sku"], a["price"], a["other_price"], a["name"], a["from_sku"]) == (0, 5, 4, None, True)
    assert got["b"]["confidence"] == 0.0 and got["b"]["tier_cols"] == []


def test_cells_alone(spark):
    rows = [("a", i, [f"LM-{i}S", "Công tắc cảm ứng", None, "1.200.000", "1.200.000"]) for i in range(5)]
    a = _mapped(spark, [], rows)["a"]
    # equal columns of prices: the lowest
    assert (a["sku"], a["name"], a["price"], a["confidence"]) == (0, 1, 3, 0.88)


def test_only_the_first_rows_count(spark):
    rows = spark.createDataFrame([("a", i, ["1000" if i < 8 else "text"]) for i in range(40)], "sheet string, idx int, text array<string>")
    (r,) = cell_stats(rows).collect()
    assert (r["n"], r["early_numeric"], r["money"], round(r["numeric"], 6)) == (12, 1.0, 1000.0, round(8 / 12, 6))


def test_no_sheets(spark):
    assert _mapped(spark, [], []) == {}

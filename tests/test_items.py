"""Items of sheet rows on literal values."""

import pytest

from tessella.operators import columns, items

ROWS = "sheet string, idx long, text array<string>, sheet_name string, section string, file_supplier string"
MAPS = ", ".join([
    "sheet string", *(f"{c} int" for c in items.MAP), *(f"{c} array<int>" for c in items.LISTS), "from_feature boolean", "from_sku boolean", "price_label string",
])


def run(spark, cases):
    """cases: (key, text, map, sheet name, section, supplier)."""
    rows = [(k, 1, t, *place) for k, t, _, *place in cases]
    fields = [f.split()[0] for f in MAPS.split(", ")]
    maps = [tuple(({"sheet": k} | m).get(f) for f in fields) for k, _, m, *_ in cases]
    return {r.sheet: r for r in items.sheet_items(spark.createDataFrame(rows, ROWS), spark.createDataFrame(maps, MAPS)).collect()}


def test_codes_types_and_subtotals(spark):
    derived = {"sku": 1, "name_source_cols": [2, 3], "feature_cols": [3], "price": 5, "from_sku": True}
    found = run(spark, [
        ("hidden", ["1", "\n\n\nOSN-KBT06", "Màu đen; Pin AA", "Mật khẩu/Vân tay/Thẻ từ/App", "1", "39.890.000"], {"hidden_sku_cols": [1], "name_source_cols": [2, 3], "feature_cols": [3], "price": 5, "from_feature": True}, "Khóa thông minh", "", ""),
        ("safe", ["1", "SBX501-4C0", "Màu đen; Khóa cơ", "Mã khóa số/Vân tay", "1", "15.000.000"], derived, "KÉT PHILIPS", "", "Philips"),
        ("lock", ["2", "DDL902-MFVP", "Màu vàng", "Vân tay/Mật mã", "1", "22.200.000"], derived, "KHÓA BIỆT THỰ", "", "Philips"),
        ("subtotal", ["", "Công tắc thông minh", "", "", "", "11.016.000"], {"name": 1, "price": 5}, "BÁO GIÁ", "", "NĐ"),
        ("real", ["", "Công tắc cơ thông minh 1 nút", "LM-1G2W-C(G)", "Kích thước 86x86", "", "945.000"], {"name": 1, "sku": 2, "specs": 3, "price": 5}, "BÁO GIÁ", "", "NĐ"),
    ])
    hidden = found["hidden"]
    assert (hidden.sku, hidden.cost, hidden.name) == ("OSN-KBT06", 39_890_000, "Khóa thông minh OSN-KBT06") and "Vân tay" in hidden.specs
    assert (found["safe"].sku, found["safe"].name, found["safe"].cost) == ("SBX501-4C0", "Két an toàn Philips SBX501-4C0", 15_000_000)
    assert found["lock"].name == "Khóa thông minh Philips DDL902-MFVP"
    assert found["subtotal"].subtotal and found["subtotal"].sku == "" and found["subtotal"].unit == "Cái" and found["subtotal"].supplier == "NĐ"
    assert not found["real"].subtotal and found["real"].sku == "LM-1G2W-C(G)" and found["real"].name == "Công tắc cơ thông minh 1 nút"


def test_current_prices_and_tiers_through_the_column_map(spark):
    header = ["STT", "Hình ảnh", "Thông số kỹ thuật", "Tính năng", "Số lượng", "Giá niêm yết", "Điều chỉnh tăng 15/04/2026", "Từ 5 bộ"]
    rows = [
        ["1", "OSN-3320", "Pin AAA", "Mật khẩu/Vân tay", "1", "4,990,000", "5,290,000", ""],
        ["2", "OSN-2602", "Pin AAA", "Mật khẩu/Vân tay", "1", "4,190,000", "4,390,000", "4,090,000"],
    ]
    sheet = spark.createDataFrame([("s", i, r, "Bảng giá OSUNO", "KHÓA NHÔM KÍNH", "Tổng hợp báo giá") for i, r in enumerate(rows)], ROWS)
    headers = spark.createDataFrame([("s", header)], "sheet string, text array<string>")
    maps = items.price_labels(columns.map_columns(headers, sheet.select("sheet", "idx", "text")), headers)
    plain, tier = items.sheet_items(sheet, maps).orderBy("idx").collect()
    assert (plain.cost, plain.listed, plain.used_tier, plain.price_mode) == (5_290_000, 5_290_000, False, "fixed")
    assert "Giá niêm yết cũ: 4.990.000đ" in plain.specs and "Điều chỉnh tăng 15/04/2026: 5.290.000đ" in plain.specs
    assert (tier.cost, tier.listed, tier.used_tier) == (4_090_000, 4_390_000, True) and tier.sku == "OSN-2602"


def test_other_prices(spark):
    row = ["Đèn LM-D12", "", "900.000", "1.500.000", "700.000"]
    cases = [
        ("loose", row, {"name": 0, "price": 1}, 700_000, 0),  # the least of all cells
        ("explicit", row, {"name": 0, "price": 2, "current_price": 3, "tier_cols": [4]}, 900_000, 1_500_000),
        ("shared", row, {"name": 0, "price": 3, "current_price": 3, "tier_cols": [4]}, 700_000, 1_500_000),
        ("dear tier", row, {"name": 0, "current_price": 4, "tier_cols": [3]}, 700_000, 700_000),  # a tier far above the price is none
        ("other", row, {"name": 0, "price": 2, "other_price": 3}, 900_000, 1_500_000),
        ("least", row, {"name": 0, "price": 2, "least_price": 4}, 900_000, 0),
        ("tier only", row, {"name": 0, "price": 1, "tier_cols": [3, 4]}, 700_000, 0),
    ]
    found = run(spark, [(k, t, m, None, None, None) for k, t, m, *_ in cases])
    assert {k: (r.cost, r.listed) for k, r in found.items()} == {k: (c, p) for k, _, _, c, p in cases}
    assert found["least"].specs == "Giá bán lẻ thấp nhất: 700.000đ"


@pytest.mark.parametrize(("text", "left"), [([], None), (["", "", ""], None), (None, None), (["Sản phẩm", "5.000.000"], None), (["Sản phẩm treo", "5.000.000"], "Sản phẩm treo"), ([None, "x"], None)])
def test_rows_without_a_name(spark, text, left):
    found = run(spark, [("s", text, {"name": 0, "price": 1}, "", "", "")])
    assert (found["s"].name if found else None) == left

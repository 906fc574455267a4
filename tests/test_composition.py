"""Variants of quotes on literal values."""

import pytest

from tessella.operators import composition as Q


@pytest.fixture(scope="module")
def quote(spark):
    make = spark.createDataFrame
    packs = make([("q", "s1", 0, "Chiếu sáng", "b"), ("q", "s2", 1, "", "zzz"), ("q", "s3", 2, "Không", None)], "quote string, scope string, pack_place int, scope_label string, selected string")
    recs = make([("q", s, r, k, f"PA {s}{r}", "", "", "Mẫu") for s in ("s1", "s2") for k, r in enumerate("ab")], "quote string, scope string, rec string, place int, title string, vendor string, tier string, template string")
    none = make([], "quote string, scope string, rec string")
    lines = make([
        ("q", 1, 1, "s1", 2.0, "Đèn", "D1", "S", 4, "Tầng 1", "", "Đèn trần", ""), ("q", 2, 2, "s1", 3.0, "Đèn", "D1", "S", 4, Q.NO_AREA, "", "Đèn trần", "Loại"),
        ("q", 3, 3, "s9", None, None, "M3", None, None, None, None, None, None), ("q", 4, 4, "s2", 0.0, "Khóa", None, None, None, None, "Mục", None, "Cửa"),
    ], "quote string, line int, place int, scope string, qty double, name string, model string, sheet string, row int, area string, section string, label string, category string")
    chosen = make([("q", v, n, p, s) for v in Q.VARIANTS for n, p, s in ((1, "p1", "user_locked"), (2, "p1", "suggested"), (4, "p2", "suggested"))], "quote string, variant string, line int, product string, source string")
    components = make([
        ("q", "s1", "b", 0, "trung tâm", True, True, 2.0), ("q", "s1", "b", 1, "cảm biến", False, True, None), ("q", "s1", "b", 2, "tay", True, False, 1.0),
        ("q", "s2", "a", 0, "lại", True, True, 1.0), ("q", "s2", "b", 0, "không chọn", True, True, 1.0),
    ], "quote string, scope string, rec string, component int, label string, required boolean, auto boolean, qty double")
    candidates = make([
        ("q", "s1", "b", 0, 0, "mid", 20.0), ("q", "s1", "b", 0, 1, "low", 10.0), ("q", "s1", "b", 0, 2, "high", 30.0), ("q", "s1", "b", 1, 0, "p1", 1.0),
        ("q", "s1", "b", 2, 0, "hand", 1.0), ("q", "s2", "a", 0, 0, "mid", 5.0), ("q", "s2", "a", 0, 1, "low", 4.0), ("q", "s2", "b", 0, 0, "other", 5.0),
    ], "quote string, scope string, rec string, component int, place int, product string, price double")
    return packs, recs, none, lines, chosen, components, candidates


def test_selected(spark, quote):
    packs, recs, none, *_ = quote
    own = {r.scope: r.rec for r in Q.selected_recommendations(packs, recs, none).collect()}
    assert own == {"s1": "b", "s2": "a"}  # an unknown id gives the first, a pack without recommendations nothing
    asked = spark.createDataFrame([("q", "s1", "a"), ("q", "s2", "b")], none.schema)
    assert {r.scope: r.rec for r in Q.selected_recommendations(packs, recs, asked).collect()} == {"s1": "a", "s2": "b"}


def test_templates_rooms_and_totals(spark, quote):
    packs, recs, none, lines, chosen, components, candidates = quote
    selected = Q.selected_recommendations(packs, recs, none)
    added = Q.template_lines(selected, components, candidates, chosen)
    got = sorted((r.variant, r.product, r.qty, r.room) for r in added.collect())
    # budget: both packs ask for the low one, standard: for the mid one; the sensor's product is used by a line
    assert got == [("budget", "low", 2.0, "Chiếu sáng"), ("premium", "high", 2.0, "Chiếu sáng"), ("premium", "mid", 1.0, "PA s2a"), ("standard", "mid", 2.0, "Chiếu sáng")]
    placed = Q.line_rooms(lines, selected)
    made = {(r.room, r.product): r for r in Q.rooms(placed, chosen, added).where("variant = 'standard'").collect()}
    assert set(made) == {("Đèn trần", "p1"), ("Cửa", "p2"), ("Chiếu sáng", "mid")}
    first = made["Đèn trần", "p1"]
    assert (first.qty, first.note, first.source, first.factor) == (5.0, "Đèn · D1 · S dòng 4 · PA: PA s1b", "bom_line", 1.0)
    assert made["Chiếu sáng", "mid"].note == "Bộ cấu hình · Mẫu · trung tâm · PA: PA s1b" and made["Cửa", "p2"].qty == 1.0
    products = spark.createDataFrame([("p1", 100.0, 60.0), ("p2", 50.0, None), ("low", 10.0, 5.0), ("mid", 20.0, 10.0), ("high", 30.0, 15.0)], "product string, price double, cost double")
    total = {r.variant: r for r in Q.variants(placed, chosen, added, products, 10.0).collect()}
    s = total["standard"]
    assert (s.device_total, s.cost_total, s.qty_total, s.labour, s.grand_total) == (590.0, 320.0, 7.0, 59.0, 649.0)
    assert (s["items"], s.locked, s.auto, s.matched, s.unmatched, s.template_lines, s.coverage, s.margin_percent, s.unmatched_sample) == (4, 1, 3, 3, 1, 1, 75, 46, ["M3"])
    empty = {r.variant: r for r in Q.variants(placed, chosen.limit(0), added.limit(0), products).collect()}
    assert len(empty) == 3 and not empty["budget"].ready and empty["budget"].unmatched_sample == ["Đèn", "Đèn", "M3", "Khóa"]


def test_other_groupings(quote):
    packs, recs, none, lines, chosen, components, candidates = quote
    selected = Q.selected_recommendations(packs, recs, none)
    rooms = lambda g: {r.line: r.room for r in Q.line_rooms(lines, selected, g).collect()}
    assert rooms("area") == {1: "Tầng 1", 2: "Loại", 3: Q.ROOM, 4: "Mục"}
    assert rooms("pack") == {1: "PA s1b", 2: "PA s1b", 3: Q.ROOM, 4: "PA s2a"}
    assert {r.room for r in Q.template_lines(selected, components, candidates, chosen, "area").collect()} == {"Bộ cấu hình: Chiếu sáng", "Bộ cấu hình: "}

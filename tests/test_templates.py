"""Saved templates on literal values."""

from tessella.operators import templates as T


def test_saved_and_deleted(spark):
    make = lambda rows: spark.createDataFrame(rows, "owner string, key string, saved_at long, name string")
    k = lambda n: f"{T.PREFIX}{n}"
    old, new = make([("o", k(1), 5, "old"), ("o", k(2), 3, "two"), ("p", k(1), 1, "p")]), make([("o", k(1), 4, "new"), ("o", k(3), 9, "three")])
    kept = T.saved(old, new, most=2)
    assert sorted((r.owner, r.key, r.name) for r in kept.collect()) == [("o", k(1), "new"), ("o", k(3), "three"), ("p", k(1), "p")]
    gone = spark.createDataFrame([("o", k(1)), ("p", "other")], "owner string, key string")
    assert sorted((r.owner, r.name) for r in T.deleted(kept, gone).collect()) == [("o", "three"), ("p", "p")]
    assert T.saved(old.limit(0), new.limit(0)).count() == 0


def test_suggestions(spark):
    headers = ["Mã SP", None, "Đơn giá"]
    sheets = spark.createDataFrame([("o", "s", headers, "Lumi 2024.xlsx"), ("o", "none", None, None)], "owner string, sheet string, headers array<string>, file string")
    exact = sheets.where("sheet = 's'").select(T.signature(sheets.headers, sheets.file).alias("x")).collect()[0].x
    assert exact == "lumi::3::ma sp|don gia"
    rows = [("o", "a", "x", exact, 1), ("o", "b", "Bảng Lumi", "::1::ma sp", 2), ("o", "c", "x", "::1::don gia", 3), ("o", "d", None, None, 4), ("q", "e", "x", exact, 5)]
    found = T.suggestions(sheets, spark.createDataFrame(rows, "owner string, key string, name string, signature string, saved_at int")).orderBy("place").collect()
    assert [(r.sheet, r.key, r.score) for r in found] == [("s", "a", 2.0), ("s", "b", 0.85), ("s", "c", 0.5)]

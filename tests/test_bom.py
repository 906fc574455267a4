"""Lines of bills of materials on literal values."""

from pyspark.sql import functions as F

from tessella.functions import bom


def test_area_rows(spark):
    rows = [["TẦNG 2", "", "3"], ["TẦNG 2", "", ""], ["TẦNG 2", "", "xx"], ["TẦNG 2", None], ["a", "b", "c", "d"], []]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, text array<string>").orderBy("k")
    assert [r.a for r in df.select(bom.area_of(F.col("text"), 2).alias("a")).collect()] == [None, "TẦNG 2", "TẦNG 2", "TẦNG 2", None, None]
    assert [r.a for r in df.select(bom.area_of(F.col("text")).alias("a")).collect()][:2] == ["TẦNG 2", "TẦNG 2"]


def test_bare_names(spark):
    cases = [
        ("XLM-S4 LM-S4 công tắc", "LM-S4", "XLM-S4  công tắc"), ("LM-S4", "lm-s4", ""), ("1. Đèn LM-S4 SL: 5", "LM-S4", "Đèn"), ("LM-S4 a LM-S4", "LM-S4", "a LM-S4"),
        ("Công tắc (LM-S4) -", "LM-S4", "Công tắc ()"), ("Đèn", "", "Đèn"), (None, "X", ""), ("a.b A+B", "A+B", "a.b"),
    ]
    df = spark.createDataFrame([(k, x, m) for k, (x, m, _) in enumerate(cases)], "k int, x string, m string").orderBy("k")
    assert [r.n for r in df.select(bom.bare_name(F.col("x"), F.col("m")).alias("n")).collect()] == [c[2] for c in cases]

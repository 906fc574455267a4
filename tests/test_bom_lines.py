"""Views of lines and solutions on literal values."""

from pyspark.sql import functions as F

from tessella.operators import bom_lines as B


def test_views(spark):
    rows = [(1, None, False, 5, "ready", "a"), (2, True, False, None, "ready", "a"), (3, False, True, 6, "ready", "a"), (4, False, False, None, None, None)]
    df = spark.createDataFrame(rows, "id int, ignored boolean, supporting boolean, product int, status string, scope string")
    ids = lambda m, more=False: [r.id for r in df.where(B.shown(m, more)).orderBy("id").collect()]
    assert {m: ids(m) for m in B.MODES} == {"core": [1, 4], "supporting": [3], "ready": [1], "review": [], "matched": [1], "unresolved": [4], "ignored": [2], "all": [1, 2, 4]}
    assert (ids("ready", True), ids("all", True), ids("scope:a"), ids("scope:b")) == ([1, 3], [1, 2, 3, 4], [1, 3], [])


def test_solutions(spark):
    cases = [("Công tắc", None, B.LIGHT), ("cb", "Camera", B.SENSORS), ("", "Camera", B.CAMERAS), (None, "camera ip", B.CAMERAS), ("xyz", "Rèm", B.CURTAINS), (None, None, B.LIGHT), ("cổng sau", "", B.GATES)]
    df = spark.createDataFrame([(k, g, c) for k, (g, c, _) in enumerate(cases)], "k int, g string, c string").orderBy("k")
    assert [r.s for r in df.select(B.solution_of(F.col("g"), F.col("c")).alias("s")).collect()] == [c[2] for c in cases]

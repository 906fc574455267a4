"""Takeoff tables, floors down and devices across: read as lines, and devices met with catalogue products."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.patterns import plain
from tessella.functions.text import clean_text

# First cells of a header row; names of rows that add up the others.
FIRST_CELLS, SUM_ROWS = ["tầng", "khu vực", "phòng"], ["tổng", "tong"]
# Devices by the words of a column, in order, with the products to look for, the first choice first: all words in name and code, or a part of the code.
DEVICES = [
    (r"1 nút|^1 nut$", [("text", "công tắc", "1 nút"), ("text", "luto 1")]),
    (r"2 nút", [("text", "công tắc", "2 nút"), ("text", "luto 2")]),
    (r"3 nút", [("text", "công tắc", "3 nút"), ("text", "luto 3")]),
    (r"4 nút", [("text", "công tắc", "4 nút"), ("text", "luto 4")]),
    (r"công tắc cổng|cong tac cong", [("text", "công tắc", "cổng")]),
    (r"trung tâm|trung tam", [("text", "trung tâm")]),
    (r"^cbcđ$|^cbcd$|chuyển động|chuyen dong", [("text", "cảm biến", "chuyển động"), ("text", "cảm biến")]),
    (r"^cbhd$|^cbhđ$|hiện diện|hien dien", [("text", "hiện diện")]),
    (r"motor", [("text", "cổng", "motor"), ("text", "motor")]),
    (r"cam.*(ngoài|ngoai)|(ngoài|ngoai).*cam", [("text", "camera", "ngoài"), ("code", "ds-2cd1047")]),
    (r"cam.*trong|trong.*cam", [("text", "camera", "trong"), ("code", "ds-2cd1347")]),
    (r"đầu ghi|dau ghi|nvr", [("text", "đầu ghi"), ("code", "ds-7616")]),
    (r"ổ cứng|o cung|hdd", [("text", "ổ cứng"), ("code", "wd43")]),
    (r"switch.*1000|1000.*switch", [("code", "switch-poe-16-1000"), ("text", "switch", "1000")]),
    (r"switch.*16|16.*switch", [("text", "switch", "16"), ("code", "ds-3e1318")]),
    (r"switch.*poe|poe.*switch", [("text", "switch", "poe")]),
    (r"wifi.*(tường|tuong|gắn|gan)|(tường|tuong|gắn|gan).*wifi", [("code", "wifi-gan-tuong"), ("text", "wifi"), ("text", "phát wifi")]),
    (r"wifi", [("text", "wifi"), ("text", "phát wifi")]),
    (r"cân bằng tải|can bang tai", [("code", "can-bang-tai"), ("text", "cân bằng")]),
    (r"rèm|rem", [("text", "rèm")]),
    (r"ổ cắm|o cam", [("text", "ổ cắm")]),
    (r"hồng ngoại|hong ngoai", [("text", "hồng ngoại")]),
]
GRAM = 5  # a column that no device fits needs this many characters to be sought in names


def line_name(group: Column, label: Column) -> Column:
    """The longer of group and label where one holds the other, accents aside, else both."""
    g, x = clean_text(group), clean_text(label)
    pg, px = plain(g), plain(x)
    held = F.contains(px, pg) | F.contains(pg, px)
    return F.when(g == "", x).when(x == "", g).when(held & (F.length(x) >= F.length(g)), x).when(held, g).otherwise(F.concat_ws(" ", g, x))


def takeoff_lines(rows: DataFrame) -> DataFrame:
    """(sheet, idx, area, title, col, grp, label, qty, shared, as_matrix) of rows (sheet, idx, text), a line for each floor and device.

    The header is the first of a sheet's first six rows whose first cell is one of
    `FIRST_CELLS`; the row below it names the devices, and a group reaches right to
    the next. Of equal labels the group is the first's and the quantity the last's
    that has one. shared: of several floors only this one has the device. as_matrix:
    two columns or more, so the sheet is read this way and not as a list. Sheets
    without such a header or quantities give nothing.
    """
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("idx"))
    cell = lambda i: F.trim(F.coalesce(F.get("text", F.lit(i)), F.lit("")))
    # the header lies in the first six rows, the devices in the seven first
    top = rows.select("sheet", "idx", "text").withColumn("r", place).where("r <= 7").withColumn("first", F.lower(cell(0)))
    heads = top.where(F.col("first").isin(FIRST_CELLS) & (F.col("r") <= 6)).groupBy("sheet").agg(F.min("r").alias("h"))
    marked = top.join(heads, "sheet")
    filled = F.trim(F.array_join(F.filter("text", lambda t: F.coalesce(t, F.lit("")) != ""), " "))
    titles = marked.where("r < h").withColumn("title", filled).where("title <> ''").groupBy("sheet").agg(F.min_by("title", "r").alias("title"))
    cells = marked.where("r in (h, h + 1)").select("sheet", (F.col("r") == F.col("h")).alias("upper"), F.posexplode("text").alias("col", "x")).where("col > 0")
    pairs = cells.groupBy("sheet", "col").agg(F.max(F.when(F.col("upper"), F.trim("x"))).alias("g"), F.max(F.when(~F.col("upper"), F.trim("x"))).alias("s"))
    across = Window.partitionBy("sheet").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("grp", F.coalesce(F.last(F.nullif("g", F.lit("")), ignorenulls=True).over(across), F.lit("")))
    devices = pairs.withColumn("label", F.coalesce(F.nullif("s", F.lit("")), "grp")).where("label <> ''")
    labels = Window.partitionBy("sheet", "label").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    devices = devices.select("sheet", "col", "label", F.first("grp").over(labels).alias("grp"), F.first("col").over(labels).alias("place"))
    starts = marked.where("r = h + 1").select("sheet", F.col("idx").alias("below")).join(titles, "sheet", "left")
    starts = starts.join(devices.groupBy("sheet").agg((F.count("*") >= 2).alias("as_matrix")), "sheet")

    floors = rows.join(starts, "sheet").where(F.col("idx") > F.col("below")).withColumn("area", cell(0)).where((F.col("area") != "") & ~F.lower("area").isin(SUM_ROWS))
    found = floors.select("sheet", "idx", "area", "title", "as_matrix", F.posexplode("text").alias("col", "x"))
    found = found.withColumn("n", F.regexp_replace("x", "[^0-9]", "").try_cast("long")).where("col > 0 and n > 0").join(devices, ["sheet", "col"])
    lines = found.groupBy("sheet", "idx", "label").agg(
        F.first("area").alias("area"), F.first("title").alias("title"), F.first("as_matrix").alias("as_matrix"), F.first("place").alias("col"), F.first("grp").alias("grp"), F.max_by("n", "col").alias("qty")
    )
    of_sheet = lines.groupBy("sheet").agg(F.countDistinct("idx").alias("n_floors"))
    of_label = lines.groupBy("sheet", "label").agg(F.count("*").alias("n_with"))
    shared = (F.col("n_with") == 1) & (F.col("n_floors") > 1)
    out = lines.join(of_label, ["sheet", "label"]).join(of_sheet, "sheet")
    return out.select("sheet", "idx", "area", F.coalesce("title", F.lit("")).alias("title"), "col", "grp", "label", "qty", shared.alias("shared"), "as_matrix")


def device_products(labels: DataFrame, products: DataFrame) -> DataFrame:
    """(label, product) for distinct labels: the first product (by order of id) of the first choice of the first device that fits, else the first whose name holds the label.

    labels: label; products: id, name, sku. Products are tested against the fixed choices
    in one pass and merged to one row a choice; other labels meet names by five characters.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    asked = labels.select("label").where("label is not null").distinct().withColumn("c", F.trim(F.lower("label")))
    device = F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(DEVICES))):
        device = F.when(F.col("c").rlike(pattern), i).otherwise(device)
    asked = asked.withColumn("device", device)
    goods = products.select("id", low("name").alias("name"), low("sku").alias("sku")).withColumn("text", F.concat_ws(" ", "name", "sku"))
    choices = [(i, k, field, words) for i, (_, found) in enumerate(DEVICES) for k, (field, *words) in enumerate(found)]
    fits = F.array(*(F.when(reduce(and_, (F.contains("sku" if field == "code" else "text", F.lit(w)) for w in words)), F.struct(F.lit(i).alias("device"), F.lit(k).alias("choice"))) for i, k, field, words in choices))
    firsts = goods.select("id", F.explode(F.array_compact(fits)).alias("f")).groupBy("f.device", "f.choice").agg(F.min("id").alias("id"))
    # one row a device
    best = firsts.groupBy("device").agg(F.min_by("id", "choice").alias("by_device"))
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - GRAM + 1), lambda i: F.substring(F.col(c), i, F.lit(GRAM)))
    open_ = asked.where(F.col("device").isNull() & (F.length("c") >= GRAM)).select("label", "c", F.substring("c", 1, GRAM).alias("gram"))
    held = goods.where(F.length("name") >= GRAM).groupBy("name").agg(F.min("id").alias("id")).select("id", "name", F.explode(F.array_distinct(gram("name"))).alias("gram"))
    named = open_.join(held, "gram").where(F.contains("name", F.col("c"))).groupBy("label").agg(F.min("id").alias("by_name"))
    found = asked.join(F.broadcast(best), "device", "left").join(named, "label", "left")
    return found.select("label", F.coalesce("by_device", "by_name").alias("product"))

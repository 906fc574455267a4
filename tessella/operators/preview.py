"""Previews of imports: items of plain sheets as the last resort, the cascade of engines, canonical lines, one summary a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.patterns import hits
from tessella.functions.text import slug
from tessella.operators.assembly import line_id
from tessella.operators.imports import SUFFIX, catalog_columns
from tessella.operators.rows import whole_row

# Header patterns of plain sheets; a header goes to the first that fits and has no column yet.
PLAIN_FIELDS = [
    ("name", "tên|sản phẩm|hàng ho[áa]|mô tả|thiết bị|vật tư|diễn giải"), ("sku", "mã|sku|code|model"), ("category", "nhóm|loại|danh mục|phân loại"),
    ("supplier", "nhà cung cấp|ncc|hãng|xuất xứ"), ("unit", "đvt|đơn vị|unit"), ("price", "giá|price|đơn giá|thành tiền"), ("specs", "thông số|kỹ thuật|quy cách"),
]
# Words of an issue's text that make it an error; warnings of files without items.
ERROR_WORDS = "lỗi|thiếu tên|không phải|failed|error"
EMPTY, LEGACY = "File không có dữ liệu", "Dùng parser cũ (legacy) vì engine v2 không trích được dữ liệu"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
HEADER_ROWS, SAMPLE = 10, 5
STATUSES = ("auto_approved", "need_review", "failed", "skipped")


def plain_items(rows: DataFrame) -> DataFrame:
    """(file, sheet, idx, name, sku, category, supplier, unit, price, specs, raw) by header words alone.

    rows: file, sheet, idx, text. Rows whose cells are all empty don't count, nor sheets of one row. The header
    is the row of the first ten with the most texts; without a name column the one that is longest in the five
    rows below is it. Prices are all digits of their cell; names need two characters.
    """
    filled = rows.where(F.exists("text", lambda t: F.coalesce(t, F.lit("")) != "")).select("file", "sheet", "idx", "text")
    # a rank filtered by a bound: no task sorts more than that many rows of a sheet
    top = filled.withColumn("r", F.row_number().over(Window.partitionBy("file", "sheet").orderBy("idx"))).where(F.col("r") <= HEADER_ROWS + SAMPLE)
    texts = F.size(F.filter("text", lambda t: (F.length(F.trim(t)) > 1) & ~t.rlike(NUMBER)))
    rank = F.when(F.col("r") <= HEADER_ROWS, F.struct(texts.alias("n"), (-F.col("r")).alias("early")))
    row = F.struct("r", "idx", "text")
    sheets = top.groupBy("file", "sheet").agg(F.max_by(row, rank).alias("head"), F.array_sort(F.collect_list(row)).alias("first")).where(F.size("first") >= 2)
    below = F.slice(F.filter("first", lambda f: f["r"] > F.col("head.r")), 1, SAMPLE)
    width = lambda c: F.aggregate(below, F.lit(0), lambda n, f: n + F.length(F.coalesce(F.get(f["text"], c), F.lit(""))))
    widest = F.array_max(F.transform("head.text", lambda _, c: F.struct(width(c).alias("n"), (-c).alias("low"))))
    sheets = sheets.select(F.struct("file", "sheet").alias("sheet"), F.col("head.idx").alias("start"), F.col("head.text").alias("text"), (-widest["low"]).alias("widest"))
    maps = catalog_columns(sheets.select("sheet", "text"), PLAIN_FIELDS).join(sheets.select("sheet", "start", "widest"), "sheet")
    maps = maps.select("sheet.file", "sheet.sheet", "start", F.coalesce("name", "widest").alias("name"), *(f for f, _ in PLAIN_FIELDS[1:]))
    cell = lambda f: F.coalesce(F.trim(F.get(F.col("text"), F.col(f"m.{f}"))), F.lit(""))
    either = lambda f, other: F.when(cell(f) != "", cell(f)).otherwise(other)
    digits = F.regexp_replace(cell("price"), "[^0-9]", "")
    named = F.substring(F.regexp_replace(F.regexp_replace("file", SUFFIX, ""), "[_-]", " "), 1, 25)
    found = filled.join(maps.select("file", "sheet", F.struct("start", *(f for f, _ in PLAIN_FIELDS)).alias("m")), ["file", "sheet"]).where(F.col("idx") > F.col("m.start"))
    return found.where(F.length(cell("name")) >= 2).select(
        "file", "sheet", "idx", cell("name").alias("name"), cell("sku").alias("sku"), either("category", F.lit("Chung")).alias("category"), either("supplier", named).alias("supplier"), either("unit", F.lit("Cái")).alias("unit"),
        F.coalesce(digits.try_cast("double"), F.lit(0.0)).alias("price"), cell("specs").alias("specs"), whole_row(F.col("text")).alias("raw"),
    )


def cascade(files: DataFrame, items: DataFrame, legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, files): the items of the first engine that found any in a file, and each file with its engine and warning.

    files: file, one row each; items and legacy share their columns, `file` among them. A file that both leave empty
    stays as a failed one: engine v2, and a warning that says so.
    """
    has = lambda df, flag: df.select("file").distinct().withColumn(flag, F.lit(True))
    own = has(items, "own")
    state = files.select("file").join(own, "file", "left").join(has(legacy, "old"), "file", "left")
    engine = F.when(F.col("own").isNull() & F.col("old"), "legacy").otherwise("v2")
    warning = F.when(F.col("own"), "").when(F.col("old"), LEGACY).otherwise(EMPTY)
    return items.unionByName(legacy.join(own, "file", "left_anti")), state.select("file", engine.alias("engine"), warning.alias("warning"))


def text_issue(message: Column) -> Column:
    """(code, level) of an issue that is only a text."""
    code = slug(message)
    return F.struct(F.when(code == "", "issue").otherwise(code).alias("code"), F.when(hits(message, ERROR_WORDS), "error").otherwise("warning").alias("level"))


def final_status(status: Column, confidence: Column, issues: Column) -> Column:
    """The canonical status: the engine's verdict first, then errors with little confidence, then little confidence alone."""
    wrong = F.exists(issues, lambda i: i["level"] == "error")
    return (
        F.when(status.isin("rejected", "failed"), "failed").when(status == "skipped", "skipped").when(status == "review", "need_review")
        .when(wrong & (confidence < 0.7), "failed").when(confidence < 0.62, "need_review").otherwise("auto_approved")
    )


def in_file(rows: DataFrame) -> DataFrame:
    """Rows with `line_no` from 1 through their file's sheets; sheets are counted first, so no task sorts a whole file."""
    counts = rows.groupBy("file", "sheet").count()
    before = F.sum("count").over(Window.partitionBy("file").orderBy("sheet").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "sheet", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row")))
    return numbered.join(starts, ["file", "sheet"]).withColumn("line_no", F.col("before") + F.col("place")).drop("before", "place")


def import_lines(items: DataFrame) -> DataFrame:
    """Canonical lines (file, line_no, line_id, status, confidence, issues, source, raw, parsed, matched) of items.

    items: file, sheet, row (both not null), name, sku, category, supplier, unit, cost, listed, least, price_mode, specs, raw, product, match_type,
    match_score, confidence, status, issues of (code, level), subtotal; nulls take the defaults. Without a product `matched` is null.
    """
    text = lambda c, other="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    money = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(0.72))))
    issues = F.coalesce("issues", F.array().cast("array<struct<code:string,level:string>>"))
    spoken = F.when(text("raw") != "", F.col("raw")).otherwise(text("name"))
    shown = F.when(money("cost") > 0, F.col("cost").cast("long").cast("string")).otherwise("")
    why = F.coalesce(F.nullif("match_type", F.lit("")), F.lit("unknown"))
    matched = F.struct(F.col("product"), text("sku").alias("sku"), text("name").alias("name"), F.coalesce("match_score", "confidence", F.lit(0.0)).alias("confidence"), why.alias("method"))
    parsed = F.struct(
        text("name").alias("name"), text("sku").alias("sku"), text("category", "Chung").alias("category"), text("supplier").alias("supplier"), text("unit", "Cái").alias("unit"), money("cost").alias("cost"), money("listed").alias("listed"),
        money("least").alias("least"), F.when(money("listed") > 0, "fixed").otherwise(text("price_mode", "markup")).alias("price_mode"), text("specs").alias("specs"), F.when(F.col("subtotal"), "generic_category_subtotal").alias("skip_reason"),
    )
    return in_file(items).select(
        "file", "line_no", line_id(text("file"), text("sheet"), F.lit(""), F.col("row").cast("string"), text("sku"), spoken, shown).alias("line_id"), final_status(F.col("status"), sure, issues).alias("status"),
        (F.floor(sure * 100 + 0.5) / 100).alias("confidence"), issues.alias("issues"), F.struct("sheet", "row", text("raw").alias("raw")).alias("source"), F.struct(spoken.alias("name"), text("sku").alias("sku"), text("unit").alias("unit"), money("cost").alias("price")).alias("raw"),
        parsed.alias("parsed"), F.when(F.col("product").isNotNull(), matched).alias("matched"),
    )


def previews(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row a file, also without lines: counts by status, matched and new lines, mean confidence of lines not skipped, engine and warning. files: file, engine, warning."""
    status, gone = F.col("status"), F.col("status") == "skipped"
    known = F.col("matched").isNotNull()
    # hundredths are summed as whole numbers, so the mean does not depend on the order
    counts = lines.groupBy("file").agg(
        F.count("*").alias("total_rows"), F.count_if(~gone).alias("parsed_items"), *(F.count_if(status == s).alias(s) for s in STATUSES), F.count_if(known).alias("matched"),
        F.count_if(~known & ~status.isin("failed", "skipped")).alias("new"), F.sum(F.when(~gone, F.round(F.col("confidence") * 100).cast("long"))).alias("sure"),
    )
    found = files.join(counts, "file", "left")
    numbers = ["total_rows", "parsed_items", *STATUSES, "matched", "new"]
    mean = F.coalesce(F.col("sure") / F.nullif("parsed_items", F.lit(0)), F.lit(0.0))
    return found.select("file", "engine", "warning", *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers), (F.floor(mean + 0.5) / 100).alias("confidence"))


def importable(lines: DataFrame) -> DataFrame:
    """The products of lines that are neither failed nor skipped."""
    kept = lines.where(~F.col("status").isin("failed", "skipped"))
    name, sku = (F.when(F.col(f"parsed.{c}") != "", F.col(f"parsed.{c}")).otherwise(F.col(f"raw.{c}")).alias(c) for c in ("name", "sku"))
    rest = (F.col(f"parsed.{c}").alias(c) for c in ("category", "supplier", "unit", "cost", "listed", "least", "price_mode", "specs"))
    return kept.select("file", "line_id", name, sku, *rest, "status", "confidence", F.col("matched.product").alias("product"))

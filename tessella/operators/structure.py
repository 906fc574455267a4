"""Structure of sheets: header rows and column profiles. Rows are (sheet, idx, text array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of header cells.
HEADER_WORDS = [
    "stt", "tt", "no", "mã", "mã sp", "mã hàng", "sku", "code", "model",
    "tên", "sản phẩm", "hàng hoá", "hàng hóa", "mô tả", "diễn giải",
    "thiết bị", "vật tư", "quy cách", "thông số", "đặc điểm", "tính năng",
    "đvt", "đơn vị", "unit", "số lượng", "sl", "qty",
    "đơn giá", "giá", "price", "thành tiền", "giá bán", "giá lẻ", "giá npp", "giá đại lý", "giá nhập",
    "xuất xứ", "hãng", "ncc", "nhà cung cấp", "hình ảnh", "ảnh", "image", "ghi chú", "màu",
]
NUMERIC = r"^[0-9.,\s]+$"


def header_score(text: Column) -> Column:
    """2 for each cell that is a header word, 1 for each that holds one in little more text, less 1 for each numeric cell."""
    words = F.array(*map(F.lit, HEADER_WORDS))

    def cell(t: Column) -> Column:
        low = F.trim(F.lower(t))
        held = F.exists(words, lambda w: F.contains(low, w) & (F.length(low) < F.length(w) + 8))
        points = F.when(F.array_contains(words, low), 2).when(held, 1).otherwise(0)
        return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(points - F.when(t.rlike(NUMERIC), 1).otherwise(0))

    return F.aggregate(F.transform(text, cell), F.lit(0), lambda a, x: a + x)


def detect_header(rows: DataFrame, within: int = 15) -> DataFrame:
    """(sheet, header_idx, score): the first of the best rows among the first `within`, with a score above 1."""
    found = rows.where(F.col("idx") < within).select("sheet", "idx", header_score(F.col("text")).alias("score")).where("score > 1")
    return found.groupBy("sheet").agg(F.max(F.struct("score", (-F.col("idx")).alias("early"))).alias("b")).select("sheet", (-F.col("b.early")).cast("int").alias("header_idx"), F.col("b.score").cast("int").alias("score"))


def profile(cells: DataFrame, field: str, cell: str) -> DataFrame:
    """Shares of numeric, code-like and long cells, and the mean length, of the cells of each field that are not blank."""
    x = F.trim(F.col(cell))
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    return cells.select(F.col(field).alias("field"), x.alias("x")).where("x <> ''").groupBy("field").agg(
        F.count("*").alias("total"), share(F.col("x").rlike(NUMERIC)).alias("numeric_ratio"),
        share(F.col("x").rlike("[A-Za-z]") & F.col("x").rlike("[0-9]") & (F.length("x") <= 30)).alias("code_ratio"),
        share(F.length("x") > 40).alias("long_ratio"), F.avg(F.length("x")).alias("avg_len"),
    )


def forward_filled_sections(rows: DataFrame, section: Column, into: str = "section") -> DataFrame:
    """Rows with the text of the last section row at or above them in their sheet."""
    order = Window.partitionBy("sheet").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(F.when(section, F.array_join("text", " ")), ignorenulls=True).over(order))


def header_oracle(rows: list[tuple]) -> str:
    """SQL for detect_header over literal rows."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cells = ", ".join(f"('{s}', {i}, {quoted(t)})" for s, i, text in rows for t in text)
    words = ", ".join(f"({quoted(w)})" for w in HEADER_WORDS)
    return f"""with cells(sheet, idx, t) as (values {cells}), words(w) as (values {words}),
points as (select sheet, idx, CASE WHEN lower(trim(t)) in (select w from words) THEN 2 WHEN exists (select 1 from words where contains(lower(trim(t)), w) and length(trim(t)) < length(w) + 8) THEN 1 ELSE 0 END
  - CASE WHEN regexp_matches(t, '^[0-9.,\\s]+$') THEN 1 ELSE 0 END as p from cells where t <> ''),
scores as (select sheet, idx, sum(p) as score from points group by 1, 2 having sum(p) > 1)
select sheet, CAST(idx AS INTEGER) as header_idx, CAST(score AS INTEGER) as score from scores qualify row_number() over (partition by sheet order by score desc, idx) = 1"""

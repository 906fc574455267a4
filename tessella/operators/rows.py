"""Classes of sheet rows, sections carried to the rows below, and counts by class. Rows have an array of cells `text`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.cleaning import not_a_product
from tessella.functions.patterns import hits
from tessella.functions.products import best_code, price_candidates

# Header cells; totals; notes of every kind; shapes of section titles.
HEADER_CELLS = [
    "stt", "tt", "no", "mã", "ma sp", "mã sp", "mã hàng", "sku", "code", "tên", "ten", "sản phẩm", "san pham", "hàng hoá", "hàng hóa", "mô tả", "diễn giải",
    "thiết bị", "vật tư", "quy cách", "thông số", "đặc điểm", "đvt", "đơn vị", "dvt", "unit", "số lượng", "sl", "qty",
    "đơn giá", "don gia", "giá", "gia", "price", "thành tiền", "thanh tien", "xuất xứ", "hãng", "ncc", "nhà cung cấp", "hình ảnh", "ảnh", "image", "ghi chú",
]
TOTALS = r"^tổng\s*(cộng|tiền|giá trị|kết)|^cộng\b|thành tiền|tổng thanh toán|\bvat\b|thuế\s*(gtgt|vat)|đã.*thuế|chưa.*thuế"
NOTES = (
    r"chiết khấu|giảm giá|khuyến mãi|ghi chú|lưu ý|chú ý|note\b|chính sách|điều kiện|điều khoản|cam kết|bảo hành|bảo trì|đổi trả|hoàn tiền"
    r"|thanh toán|chuyển khoản|ngân hàng|số tk|tài khoản|hình thức tt|giao hàng|vận chuyển|ship|thời gian giao"
    r"|hàng\s*đặt|hang\s*dat|thường\s*trong\s*vòng|thuong\s*trong\s*vong|thi\s*công|thi\s*cong|hoàn\s*thành|hoan\s*thanh|kể\s*từ\s*ngày|ke\s*tu\s*ngay"
    r"|giao\s*hàng|giao\s*hang|vận\s*chuyển|van\s*chuyen|lắp\s*đặt|lap\s*dat|hợp\s*đồng|hop\s*dong|tạm\s*ứng|tam\s*ung|nghiệm\s*thu|nghiem\s*thu"
    r"|miễn phí|tặng kèm|quà tặng|thời hạn|hiệu lực|có giá trị đến|báo giá có|cảm ơn|trân trọng|kính gửi|kính chào|liên hệ|hotline"
    r"|người (lập|báo giá|phụ trách|đại diện)|ký (tên|xác nhận)|^(địa chỉ|email|website|đt|sđt|tel)\b|^trang\s*\d|page\s*\d"
)
SECTION = r"^[IVX]+[\.\)]|^[A-Z][\.\)]\s|^(nhóm|loại|hạng mục|phần)\b"
BULLET = r"^\s*[\-–—•*+>]"
CLASSES = ("product", "section", "note", "total", "header", "blank")


def whole_row(text: Column) -> Column:
    """The cells that are not empty, with blanks between."""
    return F.array_join(F.filter(text, lambda t: F.coalesce(t, F.lit("")) != ""), " ")


def numeric_cells(text: Column) -> Column:
    return F.size(F.filter(text, lambda t: t.rlike(r"^[0-9.,\s]+$") & t.rlike("[0-9]")))


def money(text: Column) -> Column:
    """The greatest price of any cell; 0 without one."""
    prices = F.flatten(F.transform(text, lambda t: price_candidates(t)))
    return F.coalesce(F.array_max(prices), F.lit(0).cast("long"))


def row_class(text: Column, name_col: int | None = None) -> Column:
    """blank, note, header, total, section or product; the first that fits, in the order of the tests below."""
    joined, filled = whole_row(text), F.size(F.filter(text, lambda t: F.coalesce(t, F.lit("")) != ""))
    cells = F.transform(text, lambda t: F.trim(F.lower(F.coalesce(t, F.lit("")))))
    header = F.size(F.array_intersect(cells, F.array(*map(F.lit, HEADER_CELLS)))) >= 2
    price, coded = money(text), best_code(joined) != ""
    label = (filled <= 2) & (F.length(joined) <= 60)
    upper = (joined == F.upper(joined)) & joined.rlike("[A-ZĐÀ-Ỹ]")
    named = (F.length(joined) >= 3) if name_col is None else F.coalesce(F.get(text, F.lit(name_col)), F.lit("")) != ""
    return (
        F.when(joined == "", "blank")
        .when(not_a_product(joined), "note")
        .when(header & (numeric_cells(text) <= 1), "header")
        .when(hits(joined, TOTALS), "total")
        .when(hits(joined, NOTES) & ~((price > 0) & coded), "note")
        .when(joined.rlike(BULLET) & (price == 0), "note")
        .when((price == 0) & label & (upper | hits(joined, SECTION)), "section")
        .when((price >= 100) & named, "product")
        .when(coded & named & (F.length(joined) >= 5), "product")
        .when(price >= 100, "product")
        .otherwise("note")
    )


def section_title(joined: Column) -> Column:
    """A section row's text without its number."""
    return F.trim(F.regexp_replace(joined, r"(?i)^(?:[IVX]+|[A-Z])[.)]\s*", ""))


def with_sections(rows: DataFrame, sheet: str, order: str, kind: str = "class") -> DataFrame:
    """Each row with the title of the last section row above it; '' before the first."""
    above = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col(kind) == "section", section_title(whole_row(F.col("text")))), ignorenulls=True).over(above)
    return rows.withColumn("section", F.coalesce(title, F.lit("")))


def extraction_stats(rows: DataFrame, sheet: str, kind: str = "class") -> DataFrame:
    """Counts of rows by class; all but products and sections are skipped."""
    counts = (F.count_if(F.col(kind) == c).alias(f"n_{c}") for c in CLASSES)
    return rows.groupBy(sheet).agg(F.count("*").alias("n_rows"), *counts, F.count_if(~F.col(kind).isin("product", "section")).alias("n_skipped"))

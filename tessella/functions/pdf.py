"""Lines of price lists as page text: what is a section, what is skipped, code, name and specifications of the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.patterns import hits
from tessella.functions.products import money_values
from tessella.functions.text import BOUNDARY, clean_text

# Heads of table rows, words of notes, heads of sections, shapes of codes, words that names lose and end at.
SKIP_HEAD = r"^(stt|no\.|mã|ma sp|model|sku|tên|ten|đơn giá|don gia|giá|gia|ghi chú|ghi chu)(\s|$)"
SKIP_WORDS = "vat|thanh toán|thanh toan|bảo hành|bao hanh|hotline|ngân hàng|ngan hang|chuyển khoản|chuyen khoan|địa chỉ|dia chi|website|email|tổng cộng|tong cong"
SECTION_HEAD = "^(dòng|dong|nhóm|nhom|series|bảng giá|bang gia|công tắc|cong tac|đèn|den|thiết bị|thiet bi|camera|khóa|khoa|két|ket|động sản phẩm|dong san pham)"
CODES = [r"\b[A-Z]{1,6}(?:-[A-Z0-9]{1,10}){1,8}(?:\/[A-Z0-9]{1,6})?\b", r"\b[A-Z]{2,}[0-9][A-Z0-9\-\/]{2,}\b", r"\b[0-9]{2}[A-Z][A-Z0-9\-\/]{3,}\b", r"\b[A-Z]+[0-9]+[A-Z0-9\-\/]*\b"]
NO_CODE = "^(VAT|VND|NPP|LED|USB|WIFI)$"
MONEY = r"(?:[0-9]{1,3}(?:[.,][0-9]{3}){1,3}|[0-9]{5,10})(?:\s?đ)?"
UNITS = r"\b(cái|cai|bộ|bo|chiếc|chiec|set|pcs?|vnđ|vnd|đ)\b"
PRICE_WORDS = r"\b(giá|gia|đơn giá|don gia|giá npp|gia npp|giá lẻ|gia le|giá đại lý|gia dai ly)\b"
SPEC_HEAD = r"\b(chất liệu|chat lieu|nguồn cấp|nguon cap|công suất|cong suat|kích thước|kich thuoc|lỗ khoét|lo khoet|màu sắc|mau sac)\b"


def _java(pattern: str) -> str:
    return "(?iu)" + pattern.replace(r"\b", BOUNDARY)


def skipped(line: Column) -> Column:
    """Short lines, heads of tables, notes and totals."""
    t = clean_text(line)
    return (F.length(t) < 5) | hits(t, SKIP_HEAD) | hits(t, SKIP_WORDS)


def section(line: Column) -> Column:
    """A line without amounts, in capitals or with the head of a section, of 4 to 130 characters."""
    t = clean_text(line)
    return F.length(t).between(4, 130) & (F.size(money_values(t)) == 0) & ((F.upper(t) == t) | hits(t, SECTION_HEAD))


def code(line: Column) -> Column:
    """The first good code of the first shape that has any."""
    good = lambda c: ~c.rlike("(?i)" + NO_CODE) & (F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) >= 4)
    found = (F.get(F.filter(F.regexp_extract_all(line, F.lit(p.replace(r"\b", BOUNDARY)), F.lit(0)), good), F.lit(0)) for p in CODES)
    return F.coalesce(*found, F.lit(""))


def name(line: Column, sku: Column) -> Column:
    """Without amounts, numbering, units and words of prices, cut before the code and before specifications, up to 90 characters."""
    t = F.regexp_replace(clean_text(line), _java(MONEY), " ")
    t = F.regexp_replace(t, r"^[0-9]+[.)\-\s]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, _java(UNITS), " "), _java(PRICE_WORDS), " ")
    found = F.instr(t, sku)
    t = F.when((sku != "") & (found > 1), F.substring(t, F.lit(1), found - 1)).when((sku != "") & (found == 1), F.concat(F.lit(" "), F.substring(t, F.length(sku) + 1, F.length(t)))).otherwise(t)
    t = F.get(F.split(t, _java(SPEC_HEAD), 2), F.lit(0))
    return F.trim(F.substring(clean_text(F.regexp_replace(t, "[|•·]+", " ")), 1, 90))


def specs(line: Column) -> Column:
    """The line without amounts, up to 160 characters."""
    return F.trim(F.substring(clean_text(F.regexp_replace(clean_text(line), _java(MONEY), " ")), 1, 160))


def unit(line: Column) -> Column:
    return F.when(hits(line, r"\b(bộ|bo|set)\b"), "Bộ").otherwise("Cái")

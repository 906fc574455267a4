"""Imported product fields made fit for a catalogue: names without specifications, categories, suppliers, units, rows that are no products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.patterns import first_of, hits, joined, plain
from tessella.functions.products import best_code, price_candidates
from tessella.functions.text import BOUNDARY, clean_text

# Broken glyphs, wrongly decoded letters, words of specifications, junk categories, terms, contacts.
WEIRD = "[�□■█▯▮▰◆◇▶◀↔↕]"
MOJIBAKE = "(Ã|Â|á»|áº|Ä|Æ|ð|Ð|å|Å)"
SPEC_WORDS = r"\b(Chất liệu|Nguồn cấp|Nguồn điện|Dòng điện|Công suất|Công suất hoạt động|Nhiệt độ|Độ ẩm|Kích thước|Tích hợp|Loại thẻ|Tốc độ|Khoảng cách|Mã khóa|Mã khóa sử dụng|Màu sắc|Điện áp|Tần số|Chuẩn kết nối|Bảo hành|Xuất xứ|Thông số|Model|Đặc điểm|Tính năng|Tải trọng|Kích cỡ|Kết nối|Ứng dụng|Nguồn máy tính)\b"
CATEGORY_JUNK = "tổng|tong|hợp|hop|báo giá|bao gia|khóa|khoa|tài khoản|tai khoan|ngân hàng|ngan hang|hotline|điều khoản|dieu khoan|ghi chú|ghi chu|bảo hành|bao hanh"
NON_PRODUCT = r"(^|\b)(hàng\s*đặt|hang\s*dat|thi\s*công|thi\s*cong|giao\s*hàng|giao\s*hang|vận\s*chuyển|van\s*chuyen|bảo\s*hành|bao\s*hanh|bảo\s*trì|bao\s*tri|thanh\s*toán|thanh\s*toan|điều\s*khoản|dieu\s*khoan|điều\s*kiện|dieu\s*kien|hiệu\s*lực|hieu\s*luc|hợp\s*đồng|hop\s*dong|tạm\s*ứng|tam\s*ung|nghiệm\s*thu|nghiem\s*thu|lưu\s*ý|luu\s*y|ghi\s*chú|ghi\s*chu)(\b|:)"
CONTACT = r"(ngân\s*hàng|ngan\s*hang|tài\s*khoản|tai\s*khoan|số\s*tk|so\s*tk|hotline|website|email|địa\s*chỉ|dia\s*chi|mst|mã\s*số\s*thuế|ma\s*so\s*thue)"
PLACEHOLDER_CATEGORY = "^(chung|khac|khác|sản phẩm|san pham|product)$"
BAD_CATEGORY = r"(bang\s*bao\s*gia|bảng\s*báo\s*giá|bao\s*gia|báo\s*giá|tong\s*hop|tổng\s*hợp|tai\s*khoan|tài\s*khoản|ngan\s*hang|ngân\s*hàng|dieu\s*khoan|điều\s*khoản|ghi\s*chu|ghi\s*chú|bao\s*hanh|bảo\s*hành|hotline|lien\s*he|liên\s*hệ)"
# Categories by what names, codes and places speak of; the first that fits counts.
CATEGORY_RULES = [
    ("Két an toàn", r"\b(sbx|valis|safe)|két\s*an\s*toàn|ket\s*an\s*toan"),
    ("Khóa thông minh", r"\b(ddl|k20|k9|r7|q9|p100|kbt|osn|kaadas|hexa)\b|khóa\s*(thông\s*minh|cửa)?|khoa\s*(thong\s*minh|cua)?|door\s*lock|smart\s*lock|fingerprint\s*lock"),
    ("Công tắc thông minh", r"công\s*tắc|cong\s*tac|switch|\bct\b|lumi.*s\d|aqara.*switch"),
    ("Cảm biến", r"cảm\s*biến|cam\s*bien|sensor|motion|door\s*sensor|nhiệt\s*độ|nhiet\s*do|khói|khoi|gas|pir"),
    ("Bộ điều khiển trung tâm", r"hub|gateway|bộ\s*điều\s*khiển\s*trung\s*tâm|bo\s*dieu\s*khien\s*trung\s*tam|home\s*center"),
    ("Rèm thông minh", r"rèm|rem|curtain|motor\s*rèm|dong\s*co\s*rem|động\s*cơ\s*rèm"),
    ("Đèn", r"đèn|den|downlight|spotlight|tracklight|led\s*dây|led\s*day|driver|dimmer|lighting"),
    ("Lưu trữ camera", r"ổ\s*cứng|o\s*cung|hdd|hard\s*drive|wd20|wd40|purple"),
    ("Chuông cửa", r"chuông\s*cửa|chuong\s*cua|intercom|\bds-kv|\bkh6320|màn\s*hình\s*chuông|man\s*hinh\s*chuong"),
    ("Cổng tự động", r"moto\s*cổng|motor\s*cổng|cong\s*tu\s*dong|cổng\s*tự\s*động|vulcan|tay\s*đòn|tay\s*don|âm\s*sàn|am\s*san"),
    ("Camera", r"camera|nvr|dvr|poe|ipcam|ipc|đầu\s*ghi|dau\s*ghi"),
    ("Điều hòa", r"điều\s*hòa|dieu\s*hoa|air\s*conditioner|vrv|vrf|cassette|btu"),
    ("Thiết bị vệ sinh", r"bồn\s*cầu|bon\s*cau|vòi|voi|sen|lavabo|toto|inax|kohler|thiết\s*bị\s*vệ\s*sinh"),
    ("Nội thất", r"mdf|hdf|laminate|acrylic|an\s*cường|an\s*cuong|tủ\s*bếp|tu\s*bep|bàn\s*ghế|ban\s*ghe"),
    ("Phụ kiện", r"phụ\s*kiện|phu\s*kien|adapter|nguồn|nguon|pin|battery|ray|đế|de|mặt\s*dưỡng|mat\s*duong"),
]


def without_weird(x: Column) -> Column:
    """Broken glyphs and runs of white space taken out."""
    return clean_text(F.regexp_replace(clean_text(x), WEIRD, ""))


def weird_share(x: Column) -> Column:
    """Share of broken glyphs among the characters; 0 of an empty text."""
    text = clean_text(x)
    return F.when(text == "", 0.0).otherwise((F.length(text) - F.length(F.regexp_replace(text, WEIRD, ""))) / F.length(text))


def broken(x: Column) -> Column:
    return clean_text(x).rlike(WEIRD) | hits(clean_text(x), MOJIBAKE)


def split_name(name: Column, specs: Column) -> Column:
    """(name, specs, cut, long): the name cut before its first specification word, if that stands behind a head of four characters or more."""
    name, specs = clean_text(name), clean_text(specs)
    head = F.regexp_extract(name, "(?iu)^(.*?)" + SPEC_WORDS.replace(r"\b", BOUNDARY), 1)
    cut = hits(name, SPEC_WORDS) & (F.length(head) > 6) & (F.length(F.trim(head)) >= 4)
    short = F.when(cut, F.trim(head)).otherwise(name)
    tail = F.trim(F.substring(name, F.length(head) + 1, F.length(name)))
    whole = F.when(cut, F.array_join(F.filter(F.array(tail, specs), lambda t: t != ""), " | ")).otherwise(specs)
    return F.struct(short.alias("name"), whole.alias("specs"), cut.alias("cut"), (F.length(short) > 130).alias("long"))


def clean_category(x: Column, fallback: str = "Chung") -> Column:
    """The category, or the fallback for empty, broken, long and junk ones."""
    raw = clean_text(x)
    return F.when((raw == "") | broken(raw) | (F.length(raw) > 60) | hits(raw, CATEGORY_JUNK), fallback).otherwise(raw)


def clean_supplier(x: Column, fallback: Column) -> Column:
    """The supplier, or the fallback for empty, broken and long ones and for contacts, banks and junk."""
    raw = clean_text(x)
    return F.when((raw == "") | broken(raw) | (F.length(raw) > 80) | hits(raw, CONTACT) | hits(raw, CATEGORY_JUNK), clean_text(fallback)).otherwise(raw)


def clean_unit(x: Column) -> Column:
    """The unit; 'Cái' for empty, broken and long ones."""
    raw = without_weird(x)
    return F.when((raw == "") | (F.length(raw) > 18) | broken(x), "Cái").otherwise(raw)


def not_a_product(x: Column) -> Column:
    """Contacts and banks, and terms unless they have both a code and a price."""
    raw = clean_text(x)
    return hits(raw, CONTACT) | (hits(raw, NON_PRODUCT) & ~((best_code(raw) != "") & (F.size(price_candidates(raw)) > 0)))


def bad_category(x: Column) -> Column:
    raw = clean_text(x)
    return (raw == "") | (F.length(raw) > 60) | hits(raw, BAD_CATEGORY) | hits(plain(raw), BAD_CATEGORY)


def infer_category(category: Column, name: Column, sku: Column, specs: Column, place: Column, supplier: Column, raw: Column, fallback: str | Column = "Chung") -> Column:
    """A good category as it is; else the first rule that fits name, code, place or supplier; else with specifications and raw text; else the fallback."""
    own = clean_text(category)
    near, all_of = joined(name, sku, place, supplier), joined(name, sku, specs, place, supplier, raw)
    either = lambda x, pattern: hits(x, pattern) | hits(plain(x), pattern)
    kept = F.when((own != "") & ~hits(own, PLACEHOLDER_CATEGORY) & ~bad_category(own), own)
    return F.coalesce(kept, first_of(near, CATEGORY_RULES, either), first_of(all_of, CATEGORY_RULES, either), F.lit(fallback))

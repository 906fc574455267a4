"""Display names of imported items: brand, product type, model, short features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.patterns import first_of, hits, joined, plain
from tessella.functions.products import code_candidates
from tessella.functions.text import BOUNDARY, clean_text, fold

# Brands, product types by category, code, place and specifications; the first that fits counts.
BRANDS = [("Philips", "philips"), ("Kaadas", "kaadas"), ("Hexa", "hexa"), ("Lumi", "lumi"), ("Aqara", "aqara"), ("SSEHOME", r"sse\s*home|ssehome")]
TYPES_BY_CATEGORY = [
    ("Két an toàn", r"ket\s*an\s*toan|safe"), ("Khóa thông minh", "khoa|lock"), ("Công tắc thông minh", r"cong\s*tac|switch"),
    ("Đèn", r"den|downlight|spotlight|lighting|chieu\s*sang"), ("Camera", "camera|nvr|dvr"), ("Cảm biến", r"cam\s*bien|sensor"),
    ("Rèm", r"rem|curtain|thanh\s*ray"), ("Cổng tự động", r"cong\b|gate|motor"),
]
TYPES_BY_CODE = [("Két an toàn", "^sbx|^valis"), ("Khóa thông minh", "^ddl|^k20|^p100|^r100|^kbt|^ktp")]
TYPES_BY_PLACE = [
    ("Két an toàn", r"safe|sbx|valis|k[eé]t\b|ket\b|ket\s*an\s*toan"), ("Khóa thông minh", "khoa|door|lock|ddl|kaadas|hexa"), ("Công tắc thông minh", r"cong\s*tac|switch"),
    ("Đèn", "den|downlight|spotlight|lighting"), ("Camera", "camera|nvr|dvr"), ("Cảm biến", r"cam\s*bien|sensor"),
]
TYPES_BY_SPECS = [("Két an toàn", r"safe|sbx|valis|ket\s*an\s*toan"), ("Khóa thông minh", "khoa|door|lock")]
COLOURS = "đen|trắng|xám|bạc|vàng|đồng|đỏ|xanh|tím|nâu|hồng|cam|gold|silver|black|white|gray|grey|red|blue|green|champagne"
SPEC_ONLY = "Phương thức|mở khóa|Vân tay|Mật mã|Thẻ từ|Chìa cơ|Bluetooth|Gateway|Wifi|Camera|Face|Nguồn|Công suất|Kích thước|Qui cách|Quy cách|Chất liệu|Màu sắc"
DIMENSIONS = r"(?:^|\b)[LWH]?\s*\d{2,4}(?:[.,]\d+)?\s*[*x×]\s*[LWH]?\s*\d{2,4}"
GENERIC_NAMES = [
    "cong tac thong minh", "cong tac", "cong tac dien thong minh", "camera", "khoa thong minh", "khoa", "cam bien", "ket an toan",
    "wifi", "o cam", "rem", "den", "bo dieu khien trung tam", "cong tu dong", "motor", "dau ghi", "switch", "san pham",
]
NO_MODEL = r"^(n\/?a|na|null|none)$"


def model_text(sku: Column) -> Column:
    """Dashes without blanks; nothing for n/a and the like; weights behind the model dropped."""
    s = F.regexp_replace(clean_text(sku), r"\s*[-–—]\s*", "-")
    weight = r"\d+(?:[.,]\d+)?\s*(kg|kgs|g|gram)" + BOUNDARY + ".*$"
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)\s*\|\s*" + weight, ""), r"(?i)\s+" + weight, "")
    return F.when(hits(clean_text(sku), NO_MODEL), "").otherwise(clean_text(s))


def brand_of(sheet: Column, section: Column, supplier: Column) -> Column:
    return F.coalesce(first_of(plain(F.concat_ws(" ", sheet, section, supplier)), BRANDS), F.lit(""))


def type_of(sheet: Column, section: Column, specs: Column, sku: Column, category: Column) -> Column:
    """The product type by category, else by code, else by section and sheet, else by specifications."""
    place = plain(F.concat_ws(" ", section, sheet))
    return F.coalesce(
        first_of(plain(category), TYPES_BY_CATEGORY), first_of(plain(sku), TYPES_BY_CODE), first_of(place, TYPES_BY_PLACE), first_of(plain(specs), TYPES_BY_SPECS), F.lit("Sản phẩm")
    )


def colour_only(x: Column) -> Column:
    return hits(clean_text(x), rf"^({COLOURS})([\s\/,\-]*({COLOURS}))*$")


def specs_only(x: Column) -> Column:
    text = clean_text(x)
    return hits(text, SPEC_ONLY) | hits(text, DIMENSIONS) | (F.length(text) > 115)


def generic_name(x: Column) -> Column:
    """A bare product type without model or detail."""
    return fold(F.trim(F.regexp_replace(F.lower(clean_text(x)), r"[.\s]+$", ""))).isin(GENERIC_NAMES)


def display_name(name: Column, model: Column, kind: Column, brand: Column) -> Column:
    """Type, brand unless the model has it, and model; the name as it is without a model."""
    named = joined(kind, F.when(F.contains(plain(model), plain(brand)), "").otherwise(brand), model)
    return F.when(model == "", clean_text(name)).otherwise(clean_text(named))


def must_derive_name(name: Column, sku: Column) -> Column:
    """Whether a name says nothing beside the code: none, the code itself, colours or specifications only."""
    n = clean_text(name)
    return (sku != "") & ((n == "") | (n == clean_text(sku)) | colour_only(n) | specs_only(n))


def short_feature(x: Column) -> Column:
    """Fifty characters, or three of more than three parts."""
    parts = F.filter(F.transform(F.split(x, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) <= 3, F.substring(x, 1, 50)).otherwise(F.concat(F.array_join(F.slice(parts, 1, 3), "/"), F.lit("...")))


def hidden_code(cells: Column) -> Column:
    """The last code of the first cell that has any."""
    codes = F.filter(F.transform(cells, lambda c: code_candidates(c)), lambda c: F.size(c) > 0)
    return F.coalesce(F.element_at(F.get(codes, F.lit(0)), -1), F.lit(""))


def with_spec(specs: Column, more: Column) -> Column:
    """Specifications with one more part, unless they have it already."""
    specs, more = F.coalesce(specs, F.lit("")), clean_text(more)
    return F.when((more == "") | F.contains(plain(specs), plain(more)), specs).otherwise(F.when(specs == "", more).otherwise(F.concat(specs, F.lit(" · "), more)))


def subtotal_suspect(name: Column, sku: Column, specs: Column) -> Column:
    """A generic name without code or specifications: the total of a group, by all looks."""
    return (F.coalesce(sku, F.lit("")) == "") & (F.length(clean_text(specs)) < 4) & generic_name(name)

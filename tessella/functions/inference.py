"""What a text is about or looks like: domain, code or name, order number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that tell a domain; of equal scores the first domain counts.
DOMAIN_WORDS = {
    "smarthome": ["công tắc", "cảm biến", "zigbee", "smart", "lumi", "wifi", "ổ cắm", "dimmer", "điều khiển", "bộ điều khiển", "module"],
    "lighting": ["đèn", "downlight", "spotlight", "led", "lighting", "rọi", "panel", "âm trần", "luminaire", "chiếu sáng"],
    "lock": ["khóa", "khoá", "vân tay", "mật mã", "door lock", "ddl", "smart lock", "thẻ từ", "khóa cửa"],
    "gate": ["cổng", "motor", "barrier", "gate", "tay đòn", "cổng trượt", "âm sàn", "vulcan", "ayros"],
    "curtain": ["rèm", "thanh ray", "kéo tay", "màn", "curtain", "track", "động cơ rèm", "âm trần"],
    "hvac": ["điều hòa", "máy lạnh", "hvac", "fcu", "ahu", "quạt", "thông gió", "ống gió"],
    "electrical": ["dây", "cáp", "cb", "aptomat", "mccb", "tủ điện", "ổ cắm", "công tắc điện", "đèn"],
    "furniture": ["tủ", "bàn", "ghế", "giường", "kệ", "sofa", "nội thất", "cabinet"],
    "plumbing": ["vòi", "sen", "bồn", "lavabo", "chậu rửa", "thiết bị vệ sinh", "bồn cầu", "sen tắm"],
    "camera": ["camera", "hikvision", "dahua", "đầu ghi", "nvr", "dvr", "ip camera", "ptz"],
}
# Words of terms and notes that are no products.
TERMS = (
    "miễn phí|vận chuyển|lắp đặt tại|bảo hành|chính sách|thanh toán|giao hàng|chuyển khoản|đổi trả|thay thế vô điều kiện|báo giá có|thời hạn|có hiệu lực|"
    "cảm ơn|trân trọng|kính gửi|ghi chú|lưu ý|điều kiện|cam kết|chiết khấu|hotline|liên hệ|website|địa chỉ"
)
ROMANS = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


def speaks_of(text: Column, domain: str) -> Column:
    """Whether a text has one of the domain's words, whatever its case."""
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for word in DOMAIN_WORDS[domain]:
        hit = hit | low.contains(word)
    return hit


def looks_like_code(text: Column) -> Column:
    """A dash or slash in it, or a digit and no lower-case letter."""
    return text.rlike("[-/]") | ((F.upper(text) == text) & text.rlike("[0-9]"))


def junk(name: Column, cost: Column, code: Column) -> Column:
    """List items and numbered clauses; terms and texts over 80 characters where there is neither price nor code."""
    name = F.trim(F.coalesce(name, F.lit("")))
    bare = (F.coalesce(cost, F.lit(0)) <= 0) & (F.trim(F.coalesce(code, F.lit(""))) == "")
    return name.rlike(r"^[-•*+]|^[0-9]+[.)]\s") | (bare & (name.rlike(f"(?iu){TERMS}") | (F.length(name) > 80)))


def roman(n: Column) -> Column:
    """Roman numeral with one X for every ten; '' below 1."""
    n = F.greatest(n.cast("int"), F.lit(0))
    return F.concat(F.repeat(F.lit("X"), F.floor(n / 10).cast("int")), F.get(F.array(*map(F.lit, ROMANS)), n % 10))


def roman_order(name: Column) -> Column:
    """1 to 10 for a name that starts with that roman numeral and a dot, else 99."""
    head = F.regexp_extract(F.coalesce(name, F.lit("")), r"^(I{1,3}|IV|V|VI{0,3}|IX|X)\.", 1)
    place = F.array_position(F.array(*map(F.lit, [*ROMANS[1:], "X"])), head)
    return F.when(place > 0, place).otherwise(99).cast("int")

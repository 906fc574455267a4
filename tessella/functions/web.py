"""Values out of web pages: entities, visible text, names, prices, codes, addresses, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import BOUNDARY, SPACES

LOWEST, HIGHEST = 1_000, 1_000_000_000
NAME_CHARS, TEXT_CHARS, CODE_CHARS = 180, 600, 48

# Named entities, words that buttons add to a name, shapes of prices and codes, and what tells images apart.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "times": "×", "reg": "®", "copy": "©", "trade": "™", "deg": "°",
}
BUTTONS = "mua ngay|thêm vào giỏ hàng|xem nhanh|chi tiết|add to cart|sale|new"
GROUPED = r"[0-9]{1,3}(?:[.,][0-9]{3}){1,5}"
CURRENCY = r"(?:₫|đ|vnd|vnđ|usd|\$)"
# Digits behind a letter are a code's (K10024), unless a currency stands before or behind them.
NO_CODE = r"(?<![A-Za-z](?:[0-9][0-9.,]{0,24})?)"
PRICE = rf"(?:(?:{CURRENCY})[{SPACES}]*(?:{GROUPED}|[0-9]{{5,12}})(?:[{SPACES}]*{CURRENCY})?|[{SPACES}]*(?:{GROUPED}|[0-9]{{5,12}})[{SPACES}]*{CURRENCY}|[{SPACES}]*{NO_CODE}(?:{GROUPED}|[0-9]{{5,12}}))"
PRICED = rf"khoảng[{SPACES}]*giá|₫|{BOUNDARY}(?:vnd|vnđ){BOUNDARY}|(?:^|[{SPACES}]){GROUPED}[{SPACES}]*(?:đ|₫)"
PRICE_PARTS = (rf"khoảng[{SPACES}]*giá[{SPACES}]*:.*", rf"(?:giá[{SPACES}]*)?(?:từ|den|đến)[{SPACES}]*{GROUPED}[{SPACES}]*(?:₫|đ|vnd|vnđ)?", rf"{CURRENCY}?[{SPACES}]*{GROUPED}(?:[{SPACES}]*{CURRENCY})?")
NAMED_CODE = rf"{BOUNDARY}(?:SKU|MÃ|MODEL|MÃ SẢN PHẨM|MSP)[:#{SPACES}-]*([A-Z0-9][A-Z0-9._\-/]{{3,40}}){BOUNDARY}"
PLAIN_CODE = rf"{BOUNDARY}([A-Z]{{2,}}[A-Z0-9]*[-_/][A-Z0-9][A-Z0-9._\-/]{{1,}}|[A-Z]{{2,}}[0-9]{{2,}}[A-Z0-9._\-/]*){BOUNDARY}"
NO_IMAGES = r"placeholder|blank|loading|spinner|logo|flag|avatar|icon|favicon"
IMAGE_FOLDERS, IMAGE_SIZES, NO_PRODUCTS = r"product|products|uploads|woocommerce|wp-content|media", r"-[0-9]+x[0-9]+\.", r"logo|banner|icon|flag"
IMAGE_ATTRIBUTES = (("data-large_image", 3.0), ("data-o_src", 3.0), ("data-lazy-src", 3.0), ("data-src", 3.0), ("src", 1.0))
IMAGE_PATTERNS = (
    r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+name=["']twitter:image["'][^>]+content=["']([^"']+)["']""",
    r"(?i)background-image[ \t\r\n]*:[ \t\r\n]*url\(([^)]+)\)",
)


def let(value: Column, use) -> Column:
    """A value named inside an expression: it is made once however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", "")


def _entity(body: Column) -> Column:
    """The character of an entity's body; null for an unknown one."""
    code = F.when(body.rlike("^#[0-9]{1,8}$"), F.substr(body, F.lit(2)).cast("long")).when(
        body.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substr(body, F.lit(3)), 16, 10).cast("long")
    )
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code)), 8, "0")), "UTF-32")
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    return F.coalesce(letter, F.try_element_at(names, F.lower(body)))


def decode_entities(x: Column) -> Column:
    """Entities as their characters, decimal, hexadecimal and named, also where their ampersand is itself encoded, once or twice. Unknown ones stay."""
    ampersands = "&(?:(?i:amp|#0*38|#x0*26);){0,2}"
    body = "(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]+);"

    def once(t: Column) -> Column:
        between, found = F.split(t, ampersands + body, -1), F.regexp_extract_all(t, F.lit(ampersands + body), F.lit(1))
        joined = F.zip_with(between, found, lambda b, e: F.concat(b, F.when(e.isNull(), "").otherwise(F.coalesce(_entity(e), F.concat(F.lit("&"), e, F.lit(";"))))))
        return F.when(t.contains("&"), F.array_join(joined, "")).otherwise(t)

    return let(text_of(x), once)


def visible(html: Column) -> Column:
    """Lines of text without scripts, styles and tags."""
    x = F.regexp_replace(text_of(html), "(?is)<script.*?</script>", " ")
    x = F.regexp_replace(x, "(?is)<style.*?</style>", " ")
    x = F.regexp_replace(x, "(?i)<(?:br|/p|/li|/div|/article|/h[0-9])>", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "\r", "\n")
    x = F.regexp_replace(x, "[ \t ]+", " ")
    x = F.regexp_replace(x, f"\n[{SPACES}]+", "\n")
    return decode_entities(trim(x))


def one_line(html: Column) -> Column:
    return F.regexp_replace(visible(html), "\n+", " ")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a tag's text; '' without it."""
    return decode_entities(F.regexp_extract(text_of(tag), f"(?i){name}[ \\t\\r\\n]*=[ \\t\\r\\n]*[\"']([^\"']*)[\"']", 1))


def without_prices(x: Column) -> Column:
    for pattern in PRICE_PARTS:
        x = F.regexp_replace(x, "(?iu)" + pattern, " ")
    return F.regexp_replace(F.regexp_replace(x, f"[{SPACES}]*[–—-][{SPACES}]*$", " "), f"^[{SPACES}]*[–—-][{SPACES}]*", " ")


def clean_name(x: Column) -> Column:
    """One line without tags, words of buttons and, where it names a price, prices; at most 180 characters."""
    t = F.regexp_replace(one_line(x), f"(?iu){BOUNDARY}(?:{BUTTONS}){BOUNDARY}", " ")
    t = let(t, lambda v: F.when(v.rlike("(?iu)" + PRICED), without_prices(v)).otherwise(v))
    t = F.regexp_replace(t, f"[{SPACES}]*[|·][{SPACES}]*$", "")
    return F.substring(trim(F.regexp_replace(t, f"[{SPACES}]+", " ")), 1, NAME_CHARS)


def clean_description(x: Column) -> Column:
    return F.substring(trim(F.regexp_replace(one_line(x), f"[{SPACES}]+", " ")), 1, TEXT_CHARS)


def first_price(x: Column) -> Column:
    """(value, raw) of the first price from 1,000 to 1,000,000,000 in a text; null without one."""
    found = F.regexp_extract_all(text_of(x), F.lit("(?iu)" + PRICE), F.lit(0))
    priced = F.transform(found, lambda raw: F.struct(F.regexp_replace(raw, "[^0-9]", "").cast("long").alias("value"), raw.alias("raw")))  # 18 digits at most
    return F.get(F.filter(priced, lambda p: p["value"].between(LOWEST, HIGHEST)), F.lit(0))


def price_value(x: Column) -> Column:
    return F.coalesce(first_price(x)["value"], F.lit(0).cast("long"))


def clean_code(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.upper(text_of(x)), r"[^A-Z0-9._\-/]", ""), 1, CODE_CHARS)


def find_code(x: Column) -> Column:
    """The first code that a word such as SKU or model announces, else the first that looks like one; '' without."""
    up = F.upper(text_of(x))
    return clean_code(F.coalesce(F.nullif(F.regexp_extract(up, NAMED_CODE, 1), F.lit("")), F.regexp_extract(up, PLAIN_CODE, 1)))


def absolute_url(raw: Column, base: Column) -> Column:
    """An address seen from a page: scheme, host, folder and steps up resolved; '' for none and for inline data. Letters stay as they are, not percent-encoded."""
    origin = F.regexp_extract(text_of(base), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(text_of(base), "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(text_of(base), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(text_of(base), "^[^?#]*(\\?[^#]*)?", 1)

    def resolved(s: Column) -> Column:
        own = F.regexp_extract(s, "^([^?#]*)", 1)
        full = F.when(s.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), own))
        full = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
        last = F.when(F.element_at(F.split(full, "/"), -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        step = lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(p == ".", kept).otherwise(F.concat(kept, F.array(p)))
        parts = F.aggregate(F.slice(F.split(full, "/"), 2, F.size(F.split(full, "/"))), F.array().cast("array<string>"), step)
        return F.concat(origin, F.lit("/"), F.array_join(F.concat(parts, last), "/"), F.substr(s, F.length(own) + 1))

    def use(s: Column) -> Column:
        return (
            F.when((s == "") | s.startswith("data:"), "").when(origin == "", s).when(s.startswith("//"), F.concat(scheme, s))
            .when(s.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.regexp_replace(s, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)$", "$1/"))
            .when(s.startswith("#"), F.concat(origin, F.when(path == "", "/").otherwise(path), query, s))
            .when(s.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), s)).otherwise(resolved(s))
        )

    return let(trim(text_of(raw)), use)


def image_address(raw: Column, base: Column) -> Column:
    """An image's address; '' for inline ones, scalable graphics, placeholders, logos and icons."""
    plain = decode_entities(F.regexp_replace(trim(text_of(raw)), "^['\"]|['\"]$", ""))

    def use(s: Column) -> Column:
        url = absolute_url(s, base)
        bad = (s == "") | s.startswith("data:") | s.startswith("blob:") | s.rlike("(?i)^(about:blank|javascript:)")
        return F.when(bad, "").otherwise(let(url, lambda u: F.when(u.rlike(f"(?i){NO_IMAGES}") | u.rlike(r"(?i)\.svg(?:\?|#|$)"), "").otherwise(u)))

    return let(plain, use)


def widest(srcset: Column) -> Column:
    """The address of the widest entry of a srcset list, the first of equal ones; '' for an empty list."""
    parts = F.filter(F.transform(F.split(text_of(srcset), ","), trim), lambda p: p != "")
    width = lambda p: F.coalesce(F.regexp_extract(F.coalesce(F.get(F.split(p, f"[{SPACES}]+"), F.lit(1)), F.lit("")), "([0-9]+)w", 1).try_cast("long"), F.lit(0).cast("long"))
    ranked = F.transform(parts, lambda p, k: F.struct(width(p).alias("w"), (-k).alias("early"), F.get(F.split(p, f"[{SPACES}]+"), F.lit(0)).alias("url")))
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))


def best_image(block: Column, base: Column) -> Column:
    """The image of a piece of HTML with the highest score, the first of equal ones.

    Attributes that hold full sizes weigh more than src, the widest of a srcset most; folders of uploads and products count for an image, banners against it.
    """
    html = text_of(block)

    def scored(raw: Column, score: float) -> Column:
        def use(url: Column) -> Column:
            points = lambda pattern, n: F.when(url.rlike(pattern), F.lit(n)).otherwise(F.lit(0.0))
            return F.struct((F.lit(score) + points(f"(?i){IMAGE_FOLDERS}", 3.0) + points(IMAGE_SIZES, 0.5) + points(f"(?i){NO_PRODUCTS}", -6.0)).alias("score"), url.alias("url"))

        return let(image_address(raw, base), use)

    def of_tag(tag: Column) -> Column:
        sets = F.coalesce(F.nullif(attribute(tag, "data-srcset"), F.lit("")), attribute(tag, "srcset"))
        return F.array(*(scored(attribute(tag, name), score) for name, score in IMAGE_ATTRIBUTES), scored(widest(sets), 4.0))

    found = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<img\b([^>]*)>"), F.lit(1)), of_tag))
    for pattern in IMAGE_PATTERNS:
        found = F.concat(found, F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda raw: scored(raw, 0.5)))
    ranked = F.transform(F.filter(found, lambda c: c["url"] != ""), lambda c, k: F.struct(c["score"].alias("score"), (-k).alias("early"), c["url"].alias("url")))
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))


# Lines that are no names of products, and what gives away running text.
MENU = "menu|tìm kiếm|search|liên hệ|catalogue|catalog|video|trang chủ|giới thiệu|tin tức|đối tác|tuyển dụng|nhà phân phối|tiếng việt|tiếng anh"
NO_NAMES = (
    f"^(?:{MENU})$", "^(?:xem thêm|mua ngay|thêm vào giỏ hàng|add to cart|hết hàng|khoảng giá)$", "^(?:thiết bị điện thông minh|bắt đầu với lumi)$", rf"^[0-9]+(?:\.[0-9]+)*\.[{SPACES}]+",
    "^(?:ví dụ|trong thời đại|các thiết bị|những sản phẩm|với khả năng|bộ điều khiển .* giúp|cảm biến .* đóng vai trò)",
)
PROSE_STARTS = "^(?:dac biet|day la|voi |tu viec|duoi day|tham khao|chung toi|nha thong minh|lumi la|lumi luon|viec lua chon|mot trong|cac thiet bi|nhung thiet bi|thiet bi dien thong minh tao ra)"
PROSE_WORDS = r"\b(?:nguoi dung|khach hang|thi truong|phat trien|lua chon|khong gian|giai phap|thuong hieu|thiet ke hien dai|giup ban|cho phep|mang den|dam bao|cung cap|dap ung|trai nghiem|cuoc song|chat luong hang dau|make in vietnam|tu hao smart home)\b"
BAD_NAMES = ("^(?:image|banner|flag icon|logo|placeholder)$", rf"khoảng[{SPACES}]*giá|gia[{SPACES}]*tu|giá[{SPACES}]*từ|₫|{BOUNDARY}(?:vnd|vnđ){BOUNDARY}", rf"^[–—-][{SPACES}]*[0-9]")
NO_LINES = "tổng cộng|subtotal|total|giỏ hàng|cart|shipping|giao hàng|bảo hành|hotline|email|địa chỉ"
LETTERS = "[a-zà-ỹ]"


def is_prose(name: Column) -> Column:
    """Whether a cleaned name reads like advertising or running text rather than a name."""
    from tessella.functions.text import learning_key

    def use(n: Column) -> Column:
        words = F.size(F.split(n, " "))
        commas = F.length(F.regexp_replace(name, "[^,;:]", ""))
        return (n != "") & (
            (words > 22) | ((words > 15) & (commas >= 2)) | (name.rlike("[:.!?…]$") & (words > 8)) | n.rlike(PROSE_STARTS) | (n.rlike(PROSE_WORDS) & (words > 9))
        )

    return let(learning_key(name), use)


def is_name(cleaned: Column) -> Column:
    """Whether a cleaned line can name a product: 4 to 155 characters with a letter and no price, no menu entry, button, numbered heading or prose."""
    bad = first_price(cleaned).isNotNull() | ~cleaned.rlike(f"(?iu){LETTERS}") | is_prose(cleaned)
    for pattern in NO_NAMES:
        bad = bad | cleaned.rlike("(?iu)" + pattern)
    return F.length(cleaned).between(4, 155) & ~bad


def is_bad_name(cleaned: Column) -> Column:
    bad = ~F.length(cleaned).between(4, 155) | is_prose(cleaned)
    for pattern in BAD_NAMES:
        bad = bad | cleaned.rlike("(?iu)" + pattern)
    return bad


def is_menu(cleaned: Column, href: Column) -> Column:
    """Whether a link belongs to the page's navigation, by its text or by a target within the page, mail, telephone or script."""
    return cleaned.rlike(f"(?iu)^(?:{MENU}|bỏ qua nội dung|xem thêm)$") | href.startswith("#") | href.rlike("(?i)^mailto:|^tel:|javascript:")


def is_product_line(line: Column) -> Column:
    return F.length(line).between(8, 220) & ~F.lower(line).rlike(NO_LINES) & line.rlike(f"(?iu){LETTERS}") & first_price(line).isNotNull()


def page_key(url: Column) -> Column:
    """An address for comparison: lower case, without its fragment and its tracking parameters."""
    plain = F.regexp_replace(trim(text_of(url)), "#.*$", "")
    kept = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(?:utm_|fbclid|gclid)"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.regexp_replace(F.lower(F.concat(F.regexp_replace(plain, r"\?.*$", ""), query)), f"[{SPACES}]+", "")


def last_image(block: Column, base: Column) -> Column:
    """The last usable image of a piece of HTML: of each tag its widest, else its first full-size address; ''."""

    def of_tag(tag: Column) -> Column:
        sets = F.coalesce(F.nullif(attribute(tag, "data-srcset"), F.lit("")), attribute(tag, "srcset"))
        first = F.coalesce(F.nullif(widest(sets), F.lit("")), *(F.nullif(attribute(tag, name), F.lit("")) for name, _ in IMAGE_ATTRIBUTES), F.lit(""))
        return image_address(first, base)

    found = F.filter(F.transform(F.regexp_extract_all(text_of(block), F.lit(r"(?i)<img\b([^>]*)>"), F.lit(1)), of_tag), lambda u: u != "")
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))

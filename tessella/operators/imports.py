"""Smaller steps of imports and quotes: columns by header alone, suppliers by file name, products for variants, lines moved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.cleaning import clean_supplier
from tessella.functions.patterns import first_of, hits, plain
from tessella.functions.text import BOUNDARY, clean_text, fold, learning_key

# Header patterns of a catalogue's fields; a header goes to the first that fits and has no column yet.
CATALOG_FIELDS = [
    ("name", "tên|sản phẩm|hàng hoá|hàng hóa|mô tả|thiết bị|vật tư|product|name|diễn giải"),
    ("sku", "mã|sku|code|model|part|mã hàng|mã sp|mã vt"),
    ("category", "nhóm|loại|danh mục|category|phân loại|chủng loại"),
    ("supplier", "nhà cung cấp|ncc|hãng|supplier|brand|thương hiệu|xuất xứ|nsx"),
    ("unit", "đơn vị|đvt|unit|dvt|đv"),
    ("current_price", r"điều\s*chỉnh\s*(tăng|giá)?|dieu\s*chinh\s*(tang|gia)?|giá\s*(mới|moi|điều\s*chỉnh|dieu\s*chinh)|giá\s*áp\s*dụng|gia\s*ap\s*dung|áp\s*dụng\s*từ|ap\s*dung\s*tu"),
    ("list_price", r"giá\s*(công bố|cong bo|niêm yết|niem yet)|giá\s*bán\s*lẻ\s*công\s*bố|gia\s*ban\s*le\s*cong\s*bo|public|list\s*price|msrp"),
    ("least_price", r"giá\s*bán\s*lẻ\s*thấp\s*nhất|gia\s*ban\s*le\s*thap\s*nhat|map|minimum|retail\s*min"),
    ("cost", r"giá\s*(đại lý|dai ly|nhập|nhap|gốc|goc|vốn|von)|cost|dealer|wholesale|đơn giá nhập|giá|price|đơn giá|thành tiền"),
    ("specs", "thông số|kỹ thuật|spec|mô tả|tính năng|đặc điểm|quy cách"),
    ("image", r"hình\s*ảnh|hinh\s*anh|^ảnh$|^anh$|image|photo|thumbnail|url\s*ảnh|link\s*ảnh"),
]
# Suppliers that file names speak of, and words of file names that name no supplier.
FILE_SUPPLIERS = [("SSEHOME", r"sse\s*home|ssehome"), ("Nguyên Đà", r"nguyen\s*da|nguyenda"), ("Lumi", "lumi"), ("Philips", "philips"), ("Kaadas", "kaadas"), ("Hexa", "hexa")]
FILE_NOISE = [r"\b(20\d{2}|19\d{2})\b", r"\b\d{1,2}[.\-_/]\d{1,2}[.\-_/]\d{2,4}\b", r"\b(v\d+|final|new|copy|file|catalog|price|list)\b"]
FOLDED_NOISE = r"\b(bao\s*gia|bang\s*gia|gia|dl|dai\s*ly|nha\s*cung\s*cap|cap\s*nhat|tong\s*hop|san\s*pham)\b"
KEY_NOISE = r"\b(20\d{2}|19\d{2}|bang gia|bao gia|catalog|price|dl|dai ly|cap nhat|update|file|xlsx|xls|pdf)\b"
SUFFIX = r"(?i)\.(xlsx|xls|csv|pdf)$"
# Words of cheap and of dear tiers, and the points of a variant's candidates.
CHEAP, DEAR = "pho thong|tiet kiem|basic|tp link|kingled|imou|osuno", "cao cap|premium|philips|kaadas|bas|unifi|hikvision|schneider"
LEAST_SCORE = 0.18


def catalog_columns(headers: DataFrame, patterns: list[tuple[str, str]] = CATALOG_FIELDS) -> DataFrame:
    """(sheet, a column or null for each field) of header rows (sheet, text): from left to right, each header to one field.

    Fields are bits of a number, so a step over a header is the lowest bit that fits and is not taken, however
    many fields there are. Equal header rows are mapped once.
    """
    bit = {f: 1 << i for i, (f, _) in enumerate(patterns)}
    label = lambda t: F.trim(F.lower(F.coalesce(t, F.lit(""))))
    fits = F.transform("text", lambda t: reduce(lambda n, fp: n + F.when(hits(label(t), fp[1]), bit[fp[0]]).otherwise(0), patterns, F.lit(0)))
    start = F.struct(F.lit(0).alias("taken"), F.array().cast("array<int>").alias("given"))

    def step(state: Column, fit: Column) -> Column:
        free = fit.bitwiseAND(F.bitwise_not(state["taken"]))
        lowest = free.bitwiseAND(-free)
        return F.struct(state["taken"].bitwiseOR(lowest).alias("taken"), F.concat(state["given"], F.array(lowest)).alias("given"))

    maps = headers.select("text").distinct().select("text", fits.alias("fits")).select("text", F.aggregate("fits", start, step)["given"].alias("given"))
    maps = maps.select(F.col("text").alias("header"), *(F.nullif(F.array_position("given", b) - 1, F.lit(-1)).cast("int").alias(f) for f, b in bit.items()))
    return headers.join(maps, F.col("text").eqNullSafe(F.col("header"))).select("sheet", *bit)


def _without(x: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(x, "(?i)" + pattern.replace(r"\b", BOUNDARY), by)


def file_supplier(name: Column) -> Column:
    """A known supplier in a file's name, else the name without its ending, dates and words of price lists."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), SUFFIX, ""), r"[_\-]+", " "))
    left = raw
    for pattern in FILE_NOISE:
        left = _without(left, pattern)
    left = clean_text(_without(fold(left), FOLDED_NOISE))
    return F.coalesce(first_of(plain(raw), FILE_SUPPLIERS), clean_supplier(F.when(left == "", raw).otherwise(left), F.lit("")))


def profile_key(file: Column, supplier: Column) -> Column:
    """The supplier's key, else that of the file's name without words of price lists; up to 80 characters."""
    own = learning_key(F.coalesce(supplier, F.lit("")))
    left = clean_text(_without(learning_key(F.coalesce(file, F.lit(""))), KEY_NOISE, ""))
    return F.substring(F.when(own != "", own).otherwise(left), 1, 80)


def candidate_rank(variant: str) -> Column:
    """Points of a candidate (score, chosen, vendor, tier, title, price, supplier, name, sku) for a variant."""
    named = learning_key(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("supplier", "name", "sku"))))
    vendor, dear = learning_key(F.coalesce("vendor", F.lit(""))), F.least(F.lit(220.0), F.col("price") / 100000)
    base = F.col("score") * 1000 + F.when(F.col("chosen"), 140.0).otherwise(0.0) + F.when((vendor != "") & F.contains(named, vendor), 95.0).otherwise(0.0)
    if variant == "budget":
        tier = learning_key(F.coalesce(F.nullif("tier", F.lit("")), "title", F.lit("")))
        return base + (220.0 - dear) + F.when(tier.rlike(CHEAP), 70.0).otherwise(0.0)
    if variant == "premium":
        tier = learning_key(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("tier", "title", "supplier"))))
        return base + dear + F.when(tier.rlike(DEAR), 90.0).otherwise(0.0)
    return base + 40.0


def variant_choices(lines: DataFrame, candidates: DataFrame, variants: list[str], keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """(variant, keys, product, source, confidence): the product locked by the user, else the candidate of most points, else the suggested one.

    lines: keys, locked, suggested, suggested_score; candidates: keys, place and what
    `candidate_rank` reads. Candidates under `LEAST_SCORE` don't count; of equal points
    the first is taken. Lines without any product are left out. A line's variants are
    columns until the end, so candidates and lines are sorted and shuffled once, not once a variant.
    """
    top = ranked_candidates(candidates.where(F.col("score") >= LEAST_SCORE), variants, *keys).groupBy(*keys).agg(*best_candidates(variants))
    found = lines.select(*keys, "locked", "suggested", "suggested_score").join(top, list(keys), "left")
    out = line_choices(found, variants, *keys).where(F.col("product").isNotNull())
    return out.select("variant", *keys, "product", "source", "confidence")


def ranked_candidates(candidates: DataFrame, variants: list[str], *keep: str) -> DataFrame:
    """(keep, early, product, score, points_<variant>): equal points and places leave nothing but the product to choose by."""
    return candidates.select(*keep, (-F.col("place")).alias("early"), "product", "score", *(candidate_rank(v).alias(f"points_{v}") for v in variants))


def best_candidates(variants: list[str], *more: str) -> list[Column]:
    """For an aggregate over ranked candidates: each variant's best one as a struct, null without any; rows without points don't count."""
    best = lambda points: F.max(F.when(F.col(points).isNotNull(), F.struct(F.col(points).alias("points"), "early", "product", "score", *more)))
    return [best(f"points_{v}").alias(f"best_{v}") for v in variants]


def line_choices(found: DataFrame, variants: list[str], *keep: str) -> DataFrame:
    """(variant, keep, product, source, confidence, best): a row for each variant of a line with its best candidates, product null where there is none."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"best_{v}").alias("b")) for v in variants)))
    found = found.select(*keep, "locked", "suggested", "suggested_score", each.alias("v")).select(*keep, F.col("locked").alias("l"), F.col("suggested").alias("s"), "suggested_score", "v.variant", "v.b")
    case = lambda locked, ranked, suggested: F.when(F.col("l").isNotNull(), locked).when(F.col("b").isNotNull(), ranked).when(F.col("s").isNotNull(), suggested)
    return found.select(
        "variant", *keep, case(F.col("l"), F.col("b.product"), F.col("s")).alias("product"), case(F.lit("user_locked"), F.lit("variant_suggestion"), F.lit("suggested")).alias("source"),
        case(F.lit(1.0), F.col("b.score"), F.coalesce("suggested_score", F.lit(0.45))).alias("confidence"), F.col("b").alias("best"),
    )


def moved_lines(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """(room, line, place): places from 1 by `position`, with one line of a room changed with its neighbour.

    moves: room, line, by (-1 up, 1 down), one a room; a move beyond an end changes nothing.
    """
    placed = lines.select("room", "line", F.row_number().over(Window.partitionBy("room").orderBy("position", "line")).alias("place"))
    whole = placed.groupBy("room").agg(F.max("place").alias("last"))
    asked = placed.join(moves.select("room", "line", "by"), ["room", "line"]).join(whole, "room").select("room", F.col("place").alias("a"), (F.col("place") + F.col("by")).alias("b"), "last").where(F.col("b").between(1, F.col("last")))
    place = F.when(F.col("place") == F.col("a"), F.col("b")).when(F.col("place") == F.col("b"), F.col("a")).otherwise(F.col("place"))
    return placed.join(asked, "room", "left").select("room", "line", place.alias("place"))

"""Which column of a sheet holds what: by its header, else by its first cells, with a confidence.

Headers and cells meet as one array of columns a sheet, whose length the sheet format
bounds; the steps after that are column expressions over the array, lowest column first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.naming import COLOURS
from tessella.functions.patterns import hits

# Header patterns of each field in order of precedence; the last two are prices to choose from.
FIELDS = [
    ("sku", r"^mã\s*(sp|sản phẩm|hàng|vt|thiết bị)?$|\bsku\b|\bcode\b|\bmodel\b|part\s*no|mã hàng"),
    ("name", r"tên\s*(sản phẩm|hàng|thiết bị|vật tư)?|sản phẩm|hàng ho[áa]|diễn giải|^mô tả$|^thiết bị$|^vật tư$|tên gọi"),
    ("specs", r"thông số|quy cách|đặc điểm|tính năng|kỹ thuật|mô tả (chi tiết|kỹ thuật|sản phẩm)|phương thức|màu sắc"),
    ("unit", r"^đvt$|đơn vị|^dvt$|^unit$"),
    ("category", r"nhóm|loại\b|danh mục|chủng loại|phân loại|category"),
    ("supplier", r"nhà cung cấp|^ncc$|hãng|xuất xứ|thương hiệu|brand|nsx"),
    ("current_price", r"điều\s*chỉnh\s*(tăng|giá)?|dieu\s*chinh\s*(tang|gia)?|giá\s*(mới|moi|điều\s*chỉnh|dieu\s*chinh)|giá\s*áp\s*dụng|gia\s*ap\s*dung|áp\s*dụng\s*từ|ap\s*dung\s*tu"),
    ("list_price", r"giá\s*(bán\s*lẻ\s*)?(công\s*bố|cong\s*bo)|giá\s*(niêm\s*yết|niem\s*yet)|giá\s*bán\s*lẻ\s*công\s*bố|giá\s*bán\s*lẻ$"),
    ("least_price", r"bán\s*lẻ\s*thấp\s*nhất|ban\s*le\s*thap\s*nhat|đại\s*l[ýi]\s*bán\s*lẻ\s*thấp\s*nhất"),
]
COST = r"giá\s*(nhập|vốn|gốc|npp|đại lý|sỉ)|giá\s*đại\s*l[íi]\b|giá\s*bán\s*cho\s*đại\s*l[ýi]"
PRICE = r"đơn giá|^giá$|price|thành tiền"
# Points of a price header, besides 2 for a cost and 1 for another price.
PRICE_POINTS = [
    (-2.5, r"chưa\s*bao\s*gồm\s*vat|chua\s*bao\s*gom\s*vat|tính\s*thưởng|tinh\s*thuong|doanh\s*số|doanh\s*so"),
    (-4.0, r"bán\s*lẻ\s*thấp\s*nhất|ban\s*le\s*thap\s*nhat|công\s*bố|cong\s*bo|niêm\s*yết|niem\s*yet|điều\s*chỉnh|dieu\s*chinh|giá\s*mới|gia\s*moi|áp\s*dụng\s*từ|ap\s*dung\s*tu"),
    (1.5, r"giá\s*bán\s*cho\s*đại\s*l[ýi]"),
    (1.0, r"^giá\s*đại\s*l[ýi]\s*$"),
]
# Headers of columns that hint at codes, features, names and tiers, and of those that are no names.
ROLES = [
    ("hidden_sku", r"hình\s*ảnh|hinh\s*anh|^ảnh$|^anh$|image|photo|model\s*ẩn|ma\s*an"),
    ("feature", r"tính\s*năng|tinh\s*nang|phương\s*thức|phuong\s*thuc|mở\s*khóa|mo\s*khoa|chức\s*năng|chuc\s*nang|đặc\s*điểm|dac\s*diem"),
    ("name_source", r"thông\s*số|thong\s*so|kỹ\s*thuật|ky\s*thuat|quy\s*cách|qui\s*cách|quy\s*cach|mô\s*tả|mo\s*ta|tính\s*năng|tinh\s*nang|đặc\s*điểm|dac\s*diem"),
    ("tier", r"(^|\b)(từ|tu)\s*\d+|trên\s*\d+|tren\s*\d+|\d+\s*[-–]\s*\d+\s*bộ|\d+\s*bo|số\s*lượng|so\s*luong|quantity\s*break|bulk|tier"),
]
NO_NAME = (
    r"^(bảo\s*hành|bao\s*hanh|warranty|số\s*lượng|so\s*luong|^sl$|qty|đơn\s*giá|don\s*gia|giá|gia|price|thành\s*tiền|thanh\s*tien|đơn\s*vị|don\s*vi|đvt|dvt|unit|stt|^tt$|^no$"
    r"|xuất\s*xứ|xuat\s*xu|hãng|hang|origin|ghi\s*chú|ghi\s*chu|note|hình\s*ảnh|hinh\s*anh|image|tình\s*trạng|tinh\s*trang|status|màu\s*sắc|mau\s*sac|color)"
)
DATE = r"(\d{1,2}[\/.-]\d{1,2}[\/.-]\d{2,4})"
# Words of specifications; a cell of colours only; measures.
SPECS = (
    "Chất liệu|Nguồn cấp|Nguồn điện|Dòng điện|Công suất|Nhiệt độ|Độ ẩm|Kích thước|Tích hợp|Loại thẻ|Tốc độ|Khoảng cách|Mã khóa|Màu sắc|Điện áp|Tần số|Thông số|Tính năng|Đặc điểm|Bảo hành|Xuất xứ"
    "|Phương thức|mở khóa|Vân tay|Mật mã|Chìa cơ|Thẻ từ|Bluetooth|Gateway|Wifi|App|Camera|Face|Applicative Door|Wooden doors?|Metal doors?|Glass Doors?|Qui cách|Quy cách"
)
COLOUR = rf"^({COLOURS})([\s\/\,\-]*({COLOURS}))*$"
MEASURE = r"(?:^|\b)[LWH]?\s*\d{2,4}(?:[.,]\d+)?\s*[*x×]\s*[LWH]?\s*\d{2,4}(?:[.,]\d+)?(?:\s*[*x×]\s*[LWH]?\s*\d{2,4}(?:[.,]\d+)?)?"
NUMBER, CODE = r"^[0-9.,\s]+$", r"^[A-Z0-9][A-Z0-9\-\/\.]{2,}$"

FOUND = [f for f, _ in FIELDS]
STATS = ("n", "numeric", "code", "long", "len", "specish", "early_numeric", "early_code", "money")


def cell_stats(rows: DataFrame, first: int = 12, early: int = 8) -> DataFrame:
    """(sheet, col, n, numeric, code, long, len, specish, bad, early_numeric, early_code, money) of the cells that are not blank.

    Shares and the mean length are over the first `first` rows of a sheet, the early
    ones and the mean of whole numbers from 100 up over the first `early`.
    """
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("idx"))
    top = rows.select("sheet", "idx", "text").withColumn("r", place).where(F.col("r") <= first)
    cells = top.select("sheet", "r", F.posexplode("text").alias("col", "x")).withColumn("x", F.trim("x")).where("x <> ''")
    x, soon = F.col("x"), F.col("r") <= early
    numeric = x.rlike(NUMBER) & x.rlike("[0-9]")
    code = ~numeric & x.rlike("(?i)" + CODE) & x.rlike("[A-Za-z]") & x.rlike("[0-9]")
    odd = hits(x, COLOUR) | hits(x, SPECS) | hits(x, MEASURE) | x.rlike(NUMBER)
    value = F.regexp_replace(x, "[^0-9]", "").try_cast("double")
    share = lambda test, among=None: F.avg(F.when(F.lit(True) if among is None else among, F.when(test, 1.0).otherwise(0.0)))
    found = cells.groupBy("sheet", "col").agg(
        F.count("*").alias("n"), share(numeric).alias("numeric"), share(code).alias("code"), share(~numeric & ~code & (F.length(x) > 15)).alias("long"), F.avg(F.length(x)).alias("len"),
        share(hits(x, SPECS) | (F.length(x) > 120)).alias("specish"), share(odd | (F.length(x) > 115)).alias("bad"), share(F.length(x).between(6, 85) & ~odd).alias("good"),
        share(numeric, soon).alias("early_numeric"), share(code, soon).alias("early_code"), F.avg(F.when(soon & (value >= 100), value)).alias("money"),
    )
    return found.withColumn("bad", (F.col("bad") >= 0.35) | (F.col("good") < 0.3)).drop("good")


def header_cells(headers: DataFrame) -> DataFrame:
    """(sheet, col, label, is_<field>, is_<role>, is_cost, is_price, no_name, points) of one header row a sheet."""
    cells = headers.select("sheet", F.posexplode("text").alias("col", "label")).withColumn("label", F.trim(F.coalesce("label", F.lit(""))))
    label, shown = F.col("label"), F.col("label") != ""
    fits = [(shown & hits(label, p)).alias(f"is_{f}") for f, p in [*FIELDS, *ROLES, ("cost", COST), ("price", PRICE)]]
    points = sum((F.when(hits(label, p), v).otherwise(0.0) for v, p in PRICE_POINTS), F.lit(0.0))
    return cells.select("sheet", "col", "label", *fits, (shown & hits(label, NO_NAME)).alias("no_name"), points.alias("points"))


def _one_of(col: Column, *names: str) -> Column:
    return reduce(or_, (col.eqNullSafe(F.col(n)) for n in names), F.lit(False))


def _first(fits: Callable[[Column], Column]) -> Column:
    return F.get(F.filter("cols", fits), F.lit(0))


def _best(fits: Callable[[Column], Column], score: Callable[[Column], Column]) -> Column:
    """The highest score and its column, the lowest of equals."""
    top = F.array_max(F.transform(F.filter("cols", fits), lambda c: F.struct(score(c).alias("score"), (-c["col"]).alias("low"))))
    return F.struct(top["score"].alias("score"), (-top["low"]).alias("col"))


def map_columns(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a sheet: the column of each field or null, columns by role, marks and confidence.

    headers: (sheet, text), at most one row a sheet; rows: (sheet, idx, text) below it. A sheet
    needs either. Columns count from 0. Each field takes its lowest header column that no field
    before it has; a missing name, code or price comes from the cells; a name column of
    specifications gives way to a better one, or to names derived from codes or features.
    """
    flags = [f"is_{f}" for f in [*FOUND, *(r for r, _ in ROLES), "cost", "price"]]
    both = cell_stats(rows).join(header_cells(headers), ["sheet", "col"], "full")
    filled = both.select(
        "sheet", "col", F.coalesce("label", F.lit("")).alias("label"), *(F.coalesce(f, F.lit(False)).alias(f) for f in [*flags, "no_name"]), F.coalesce("points", F.lit(0.0)).alias("points"),
        *(F.coalesce(s, F.lit(0)).alias(s) for s in STATS), F.coalesce("bad", F.lit(True)).alias("bad"),
    )
    sheets = filled.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct(*filled.columns[1:]))).alias("cols"))
    for i, f in enumerate(FOUND):
        sheets = sheets.withColumn(f, _first(lambda c: c[f"is_{f}"] & ~_one_of(c["col"], *FOUND[:i]))["col"])
    for role, _ in ROLES:
        skip = ("current_price", "list_price", "sku", "name") if role == "tier" else ()
        sheets = sheets.withColumn(f"{role}_cols", F.transform(F.filter("cols", lambda c: c[f"is_{role}"] & ~_one_of(c["col"], *skip)), lambda c: c["col"]))
    current = _first(lambda c: _one_of(c["col"], "current_price"))["label"]
    sheets = sheets.withColumn("price_date", F.nullif(F.regexp_extract(current, DATE, 1), F.lit("")))
    # the better of a cost and another price; of equals the cost
    sheets = sheets.withColumns({k: _first(lambda c: c[f"is_{k}"] & ~_one_of(c["col"], *FOUND)) for k in ("cost", "price")})
    later = F.col("cost").isNull() | (F.col("price.points") + 1 > F.col("cost.points") + 2)
    sheets = sheets.withColumn("later", F.coalesce(later, F.lit(False))).withColumns(
        {"price": F.when(F.col("later"), F.col("price.col")).otherwise(F.col("cost.col")), "other_price": F.when(F.col("later"), F.col("cost.col")).otherwise(F.col("price.col"))}
    ).drop("cost", "later")

    textual = lambda c, code: (c["n"] >= 3) & (c["numeric"] <= 0.35) & (c["code"] <= code)
    named = _best(
        lambda c: ~_one_of(c["col"], *FOUND, "price") & ~c["no_name"] & textual(c, 0.55) & (c["specish"] <= 0.25) & ~c["bad"], lambda c: F.lit(80.0) - F.abs(c["len"] - 28) + c["long"] * 5
    )
    hinted = (F.size("feature_cols") > 0) | (F.size("name_source_cols") > 0)
    sheets = sheets.withColumn("guess", named).withColumn("guess", F.when(F.col("name").isNull() & (F.col("guess.score") > 20), F.col("guess.col")))
    sheets = sheets.withColumn("name", F.coalesce("name", "guess")).withColumn("from_feature", F.col("name").isNull() & hinted)
    free = lambda c: ~_one_of(c["col"], *FOUND, "price") & ~F.array_contains("tier_cols", c["col"])
    coded = _best(lambda c: free(c) & (c["early_code"] > 0.3), lambda c: c["early_code"])
    sheets = sheets.withColumn("sku", F.coalesce(F.col("sku"), coded["col"])).withColumn("from_sku", F.col("name").isNull() & F.col("sku").isNotNull())
    priced = _best(lambda c: free(c) & (c["early_numeric"] >= 0.5) & (c["money"] > 0), lambda c: c["money"])
    sheets = sheets.withColumn("price", F.coalesce(F.col("price"), priced["col"]))

    taken = ("name", "price", "list_price", "least_price", "unit", "sku", "category", "supplier")
    other = _best(
        lambda c: ~_one_of(c["col"], *taken) & textual(c, 0.6) & c["len"].between(4, 95) & (c["specish"] <= 0.35),
        lambda c: F.lit(100.0) - F.abs(c["len"] - 28) - c["specish"] * 50 + c["long"] * 8,
    )
    sheets = sheets.withColumns({"was": _first(lambda c: _one_of(c["col"], "name")), "better": other["col"]})
    case = (
        F.when(F.col("name").isNull(), "kept").when(F.col("was.no_name"), "no_name").when((F.col("was.specish") >= 0.45) | (F.col("was.len") > 110), "specs")
        .when(F.col("was.bad") & F.col("sku").isNotNull(), "bad").otherwise("kept")
    )
    swapped, coded_only = (F.col("case") == "specs") & F.col("better").isNotNull(), F.col("case").isin("specs", "bad") & F.col("sku").isNotNull()
    sheets = sheets.withColumn("case", case).withColumn("swapped", swapped).withColumn("coded_only", coded_only & ~F.col("swapped"))
    sheets = sheets.withColumns({
        "specs": F.when(F.col("swapped") | ((F.col("case") == "specs") & F.col("coded_only")), F.coalesce("specs", "name")).otherwise(F.col("specs")),
        "from_feature": F.col("from_feature") | ((F.col("case") == "no_name") & hinted),
        "from_sku": F.col("from_sku") | F.col("coded_only") | ((F.col("case") == "no_name") & ~hinted & F.col("sku").isNotNull()),
    }).withColumn("name", F.when(F.col("swapped"), F.col("better")).when(~F.col("coded_only") & (F.col("case") != "no_name"), F.col("name")))

    has = lambda c, v: F.when(F.col(c).isNotNull(), v).otherwise(0.0)
    name_part = F.when(F.col("name").isNotNull(), 0.4).when(F.col("from_feature"), 0.24).when(F.col("from_sku"), 0.18).otherwise(0.0)
    parts = (("price", 0.28), ("list_price", 0.07), ("current_price", 0.09), ("sku", 0.2), ("unit", 0.05), ("specs", 0.05))
    confidence = F.least(F.lit(1.0), F.round(sum((has(c, v) for c, v in parts), name_part), 6))
    return sheets.select(
        "sheet", *FOUND, "price", "other_price", *(f"{r}_cols" for r, _ in ROLES), "price_date", "from_feature", "from_sku", F.col("swapped").alias("name_was_specs"), confidence.alias("confidence")
    )

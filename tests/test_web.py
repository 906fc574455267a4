"""Functions over web pages on literal values."""

from pyspark.sql import functions as F

from tessella.functions import web as W

BASE = "https://shop.example.com/a/b/list.html?page=2#x"


def values(spark, f, cases, *more):
    """What a function gives for the first values of all cases, in one job."""
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, x string")
    return [r.v for r in rows.select("k", f(F.col("x"), *map(F.lit, more)).alias("v")).orderBy("k").collect()]


ENTITIES = [
    ("a &amp; b", "a & b"), ("&amp;amp;lt;", "<"), ("&#273;&#x20AB;&#X41;", "đ₫A"), ("&#128512;", "😀"), ("&unknown; &AMP; &#0; &#xD800;", "&unknown; & &#0; &#xD800;"),
    ("&nbsp;&ndash;&deg;", " –°"), ("no entity & co", "no entity & co"), ("", ""), (None, ""), ("&#99999999999;", "&#99999999999;"),
]


def test_entities(spark):
    assert values(spark, W.decode_entities, ENTITIES) == [c[1] for c in ENTITIES]


VISIBLE = [
    ("<p>A</p><p>B<br>C</p><script>x</script><style>y</style>D", "A\nB\nC\nD"), ("a\r\n\r\n b", "a\nb"), (None, ""), ("<li>1&nbsp;000</li>", "1 000"),
]


def test_visible(spark):
    assert values(spark, W.visible, VISIBLE) == [c[1] for c in VISIBLE]


FIRST_PRICE = [
    ("Giá: 1.234.000đ", (1234000, " 1.234.000đ")), ("12,500 VND / 9,000", (12500, "12,500 VND")), ("999", None), ("0.999", None), ("₫ 56000", (56000, "₫ 56000")),
    ("2.000.000.000 rồi 5.000", (5000, " 5.000")), (None, None), ("1234567890123", None),
]


def test_first_price(spark):
    got = values(spark, W.first_price, FIRST_PRICE)
    assert [g and tuple(g) for g in got] == [c[1] for c in FIRST_PRICE]


CLEAN_NAME = [
    ("Công tắc LM-S4 1.404.000đ mua ngay", "Công tắc LM-S4"), ("Đèn New  LED | ", "Đèn LED"), ("Khoảng giá: 1.000đ - 2.000đ", ""), ("– 1.404.000đ", ""), ("<b>Ổ cắm</b> &amp; phích", "Ổ cắm & phích"),
    ("Giá từ 5.000 đ Rèm", "Rèm"), ("x" * 300, "x" * 180), ("newer sales", "newer sales"), (None, ""),
]


def test_clean_name(spark):
    assert values(spark, W.clean_name, CLEAN_NAME) == [c[1] for c in CLEAN_NAME]


FIND_CODE = [("Mã: ABC-12/x rest", "ABC-12/X"), ("SKU # k9-77.b", "K9-77.B"), ("Đèn LM-S4 xyz", "LM-S4"), ("OSN123A", "OSN123A"), ("plain words", ""), (None, "")]


def test_find_code(spark):
    assert values(spark, W.find_code, FIND_CODE) == [c[1] for c in FIND_CODE]


ABSOLUTE_URL = [
    ("/x/y", "https://shop.example.com/x/y"), ("y.html", "https://shop.example.com/a/b/y.html"), ("../z?q=1", "https://shop.example.com/a/z?q=1"), ("./", "https://shop.example.com/a/b/"), ("..", "https://shop.example.com/a/"),
    ("//cdn.example.net/i.png", "https://cdn.example.net/i.png"), ("http://other.example", "http://other.example/"), ("#top", "https://shop.example.com/a/b/list.html?page=2#top"), ("?page=3", "https://shop.example.com/a/b/list.html?page=3"),
    ("data:image/png;base64,xx", ""), ("  ", ""), (None, ""), ("mailto:a@example.com", "mailto:a@example.com"), ("../../../../up", "https://shop.example.com/up"),
]


def test_absolute_url(spark):
    assert values(spark, W.absolute_url, ABSOLUTE_URL, BASE) == [c[1] for c in ABSOLUTE_URL]


BEST_IMAGE = [
    ("<img src='/i/a.png'>", "https://shop.example.com/i/a.png"),
    ("<img src='/i/a.png' data-src='/i/b.png'>", "https://shop.example.com/i/b.png"),
    ("<img src='/i/a.png'><img src='/uploads/c.png'>", "https://shop.example.com/uploads/c.png"),
    ("<img src='a.jpg' srcset='s.jpg 100w, l.jpg 900w, m.jpg 900w'>", "https://shop.example.com/a/b/l.jpg"),
    ("<img src='logo.png'><img src='x.svg'><img src='data:xx'>", ""),
    ("<img src='/media/banner.png'><img src='z.png'>", "https://shop.example.com/a/b/z.png"),
    ("<meta property='og:image' content='/og.png'><div style=\"background-image: url('/bg.png')\">", "https://shop.example.com/og.png"),
    ("<img src='1.png'><img src='2.png'>", "https://shop.example.com/a/b/1.png"), ("no image", ""), (None, ""),
]


def test_best_image(spark):
    assert values(spark, W.best_image, BEST_IMAGE, BASE) == [c[1] for c in BEST_IMAGE]


WIDEST = [("a.jpg", "a.jpg"), ("a.jpg 1x, b.jpg 2x", "a.jpg"), (" , b.jpg 20w,c.jpg 30w ", "c.jpg"), ("", ""), (None, "")]


def test_widest(spark):
    assert values(spark, W.widest, WIDEST) == [c[1] for c in WIDEST]

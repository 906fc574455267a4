"""Products out of pages: JSON of odd shapes, bounds of links and images, the cascade's choices, merged rows against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import survivors
from tessella.sources import cards, json_products

PAGES = "page_id long, url string, html string, name string, sku string"
BASE = "https://shop.example.com/list/"


def pages(spark, *html):
    return spark.createDataFrame([(k, BASE, h, "clash", "clash") for k, h in enumerate(html)], PAGES)


def ld(*texts):
    return "".join(f'<script type="application/ld+json">{t}</script>' for t in texts)


def product(name, **more):
    return {"@type": "Product", "name": name, **more}


def test_schema_products(spark):
    deep = product("Deep")
    for _ in range(30):
        deep = {"mainEntity": deep}
    html = [
        ld(json.dumps({"@graph": [[product("In arrays", offers=[[{"price": "129000.00"}]])], {"@type": "Thing"}]})),
        ld(json.dumps(deep)),
        ld(json.dumps(product("Number", offers={"lowPrice": 55000.5, "price": 0}, brand=[{"name": "Lumi"}], sku=77123))),
        ld(json.dumps(product("Falsy", offers={"price": "", "highPrice": None, "priceSpecification": {"price": "99.000đ"}}, image={"contentUrl": "i.png"}))),
        ld('{"@context":"a","@type":"Product","name":"One"} {"@context":"b","@type":"Product","name":"Two"} {"@context": broken'),
        ld("{broken", "null", "", "[]", "7", '"text"', '{"@type":"Product","name":"After"}'),
        ld("<![CDATA[" + json.dumps(product("Data &amp;amp; more")) + "]]>"),
        ld(json.dumps({"@type": ["ItemList"], "itemListElement": [{"item": product("Item")}, product("Direct"), None]})),
        ld(json.dumps({"@type": "Other", "brand": product("Not below a known key")})), "", None,
    ]
    rows = json_products.page_products(pages(spark, *html)).orderBy("page_id", "script", "root", "path").collect()
    got = [(r.page_id, r.name, r.price, r.sku, r.brand, r.image) for r in rows]
    assert got == [
        (0, "In arrays", 129000, "", "", ""), (1, "Deep", 0, "", "", ""), (2, "Number", 55001, "77123", "Lumi", ""), (3, "Falsy", 99000, "", "", BASE + "i.png"), (4, "One", 0, "", "", ""), (4, "Two", 0, "", "", ""),
        (5, "After", 0, "", "", ""), (6, "Data & more", 0, "", "", ""), (7, "Direct", 0, "", "", ""), (7, "Item", 0, "", "", ""), (7, "Direct", 0, "", "", ""),
    ]


def test_embedded_products(spark):
    state = lambda x: f'<script id="__NUXT_DATA__">{json.dumps(x)}</script>'
    two = [{"title": "A", "price": "12.000"}, {"name": "B", "images": ["x"], "sku": "SBX-77"}, {"name": "no price"}, "text", None]
    nested = lambda n, x: x if not n else {"k": nested(n - 1, x)}
    html = [state(two), state(nested(8, two)), state(nested(9, two)), state({"b": [two[0]], "a": [[two[1], two[0]]]}), state({"items": [{"name": "x", "price": 0}, {"name": "y", "price": ""}]})]
    rows = json_products.page_products(pages(spark, *html)).orderBy("page_id", "path").collect()
    # an array on the ninth level is read, on the tenth not; single products are none
    assert [(r.page_id, r.name, r.price, r.sku) for r in rows] == [(0, "A", 12000, ""), (0, "B", 0, "SBX-77"), (1, "A", 12000, ""), (1, "B", 0, "SBX-77"), (3, "B", 0, "SBX-77"), (3, "A", 12000, "")]


def test_prices_behind_links(spark):
    link = lambda name, more="": f'<a href="/p"{more}>{name}</a>'
    html = [
        link("Just inside") + "x" * 690 + " 56.000", link("Just outside") + "x" * 698 + " 56.000", link("First") + link("Second") + " 12.000đ", link("Menu", "") .replace("Menu", "Trang chủ") + " 12.000",
        link("abc") + "12.000", '<a href="#top">To the top</a> 12.000', link("x<img alt='y'>", ' title="From title"') + " 15.000",
        '<a href="/p"><img alt="Image alone" src="/uploads/a.png"></a>' + link("Beside it") + " 15.000", "<script>" + link("In script") + " 12.000</script>", "<img src='/far.png'>" + "y" * 1400 + link("Too far") + " 12.000",
        "<img src='/near.png'>" + "y" * 1300 + link("Near") + " 12.000",
    ]
    rows = cards.linked_items(pages(spark, *html).select("page_id", F.col("url").alias("base"), "html")).orderBy("page_id").collect()
    got = {r.page_id: (r.name, r.price, r.image.removeprefix("https://shop.example.com")) for r in rows}
    assert got == {0: ("Just inside", 56000, ""), 2: ("Second", 12000, ""), 6: ("From title", 15000, ""), 7: ("Beside it", 15000, "/uploads/a.png"), 9: ("Too far", 12000, ""), 10: ("Near", 12000, "/near.png")}


def test_cascade(spark):
    card = lambda n: f'<li class="product"><img alt="Card {n}" src="/i/{n}.png"><span class="price">1{n}.000</span><!-- some more text --></li>'
    line = lambda n: f"<p>Line {n}</p><p>2{n}.000</p>"
    html = [
        card(1) + card(2) + line(3), card(1) + line(3) + line(4) + line(5), "<p>Only one 33.000 piece</p>", "<p>mục lục</p><p>Only one 33.000 piece</p>",
        '<div class="products">₫</div><div class="products">₫</div>' + line(1), "<p>Nhóm đèn</p><p>Xem thêm</p>" + line(6) + line(7) + line(8), card(1) + card(1).replace("/i/", "/other/"), "", None,
    ]
    rows = cards.html_items(pages(spark, *html)).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.extractor, r.name, r.price, r.category) for r in rows] == [
        (0, "card", "Card 1", 11000, "Web catalog"), (0, "card", "Card 2", 12000, "Web catalog"),
        (1, "card", "Card 1", 11000, "Web catalog"), *((1, "text", f"Line {n}", 20000 + 1000 * n, "Web catalog") for n in (3, 4, 5)),
        (2, "line", "Only one piece", 33000, "Web catalog"), (3, "text", "mục lục", 33000, "Web catalog"), *((5, "text", f"Line {n}", 20000 + 1000 * n, "Nhóm đèn") for n in (6, 7, 8)),
        (6, "card", "Card 1", 11000, "Web catalog"),
    ]


def test_best_items(spark):
    kinds = "page_id long, place array<int>, name string, sku string, url string, price long, image string, description string, confidence double"
    rows = [
        (1, [2], "Đèn A", "", "", 0, "", "", 0.9), (1, [0], "đen  a", "", "", 5, "", "", 0.1), (1, [1], "ĐÈN-A", "S", "", 5, None, None, 0.1), (1, [3], "ĐÈN-A", "T", "", 5, "", "", 0.1),
        (1, [4], "", "ab-1", "", 1, "", "", 0.5), (1, [5], "", "AB 1", "", 1, "i", "", 0.5), (1, [6], None, None, "http://x/?utm_a=1&b=2#c", 1, "", "", 0.5), (1, [7], "", "", "HTTP://x/?b=2", 1, "", "", 0.4), (1, [8], "", "", "", 1, "", "", 0.9),
        (2, [0], "Đèn A", "", "", 0, "", "", None),
    ]
    got = sorted((r.page_id, r.place, r.sku, r.price, r.image) for r in survivors.best_items(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(1, [0], "S", 5, None), (1, [4], "AB 1", 1, "i"), (1, [6], None, 1, ""), (2, [0], "", 0, "")]


def overlay(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        key, at, cost, listed, image, flag, specs, issues = r
        if not key:
            continue
        if key not in out:
            out[key] = [key, at, 1, flag, cost or 0, listed or 0, image or "", specs or "", list(issues or [])]
            continue
        o = out[key]
        o[2:] = [o[2] + 1, flag, cost or o[4], listed or o[5], o[6] or image or "", " | ".join(filter(None, [o[7], specs]))[:1000], (o[8] + list(issues or []))[:6]]
    return sorted(map(tuple, ((*o[:8], tuple(o[8])) for o in out.values())))


def test_merged_rows_equal_a_plain_overlay(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 20 + [f"k{rng.randrange(30)}", "", None]), k, rng.choice([0, None, k]), rng.choice([0, k, 2 * k]), rng.choice(["", None, f"i{k}"]), rng.choice("abc"), rng.choice(["", None, "s", "word" * rng.randrange(1, 9), f"spec {k}"]), rng.choice([[], None, [f"x{k}"], [f"x{k}", f"y{k}"]])) for k in range(900)]
    rows.append(("long", 2000, 1, 1, "", "a", "z" * 1500, [str(k) for k in range(9)]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at_line long, cost long, listed long, image string, flag string, specs string, issues array<string>").repartition(5)
    got = survivors.merged_rows(df, F.col("key"), "at_line", ["cost", "listed"], ["image"], ["flag"]).collect()
    assert sorted((r.key, r.place, r.n_rows, r.flag, r.cost, r.listed, r.image, r.specs, tuple(r.issues)) for r in got) == overlay(rows)


@pytest.mark.parametrize("f", [json_products.page_products, cards.html_items])
def test_no_pages(spark, f):
    assert f(pages(spark, "").where("false")).count() == 0

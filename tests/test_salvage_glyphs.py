"""Cut-off JSON and runs of glyphs against plain loops."""

import json
import math
import random

from pyspark.sql import functions as F

from tessella.operators import glyphs
from tessella.sources import json_salvage


def plain_objects(raw):
    text = (raw or "").replace("```json", "").replace("```", "").strip()
    if not text:
        return []
    canon = lambda o: json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def parse(t):
        try:
            return json.loads(t)
        except ValueError:
            return None

    whole = parse(text)
    if isinstance(whole, list):
        return [canon(x) for x in whole if isinstance(x, (dict, list))]
    if isinstance(whole, dict):
        return [canon(whole)]
    out = []

    def add(t):
        o = parse(t)
        if isinstance(o, dict) and canon(o) not in out:
            out.append(canon(o))

    for line in text.split("\n"):
        c = line.strip()
        c = c[1:].lstrip() if c[:1] in "-*" and c else c
        c = c[:-1] if c.endswith(",") else c
        if c.startswith("{") and "}" in c:
            add(c)
    scan, inside, skip, depth, start = text[text.find("[") + 1 :], False, False, 0, -1
    for i, ch in enumerate(scan):
        if inside:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                add(scan[start : i + 1])
                start = -1
    return out


def test_salvage_equals_a_plain_scanner(spark):
    full = '[{"name":"A {x} \\" ]","n":{"k":[1,{"z":2}]}},{"name":"B"},{"name":"B"},{"sku":"C\\\\"}]'
    texts = [full[:k] for k in range(len(full) + 1)]
    texts += [None, "", "  ", "```json\n" + full + "\n```", '- {"a":1},\n* {"b":2}\n{"a":1}\ntext {"c":3}', "}} {\"a\":1}", "} {{\"a\":1} [{\"b\":2}", "7", "null", '"{}"', "[1,[2],{}]", '{"a":1} {"b":2}', "{broken} {\"ok\":true}", "[" + '{"long":"' + "x" * 30_000 + '"},' * 2]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, raw string")
    got = [r.v for r in rows.select("k", json_salvage.salvaged(F.col("raw")).alias("v")).orderBy("k").collect()]
    for text, g in zip(texts, got, strict=True):
        assert g == plain_objects(text), text


def plain_lines(runs):
    tenth = lambda v: math.floor((v or 0) * 10 + 0.5) / 10
    lines = []
    for _, text, x, y in runs:
        if not (text or "").strip():
            continue
        line = next((r for r in lines if abs(r[0] - tenth(y)) < 2), None)
        if line is None:
            lines.append(line := (tenth(y), []))
        line[1].append((tenth(x), text))
    lines.sort(key=lambda r: -r[0])
    return [(y, " ".join(" ".join(t for _, t in sorted(parts, key=lambda p: p[0])).split())) for y, parts in lines]


def test_lines_equal_a_plain_loop(spark):
    rng = random.Random(5)
    pages = {p: [(k, rng.choice(["a", "b c", " ", "", None, "d  e"]), rng.choice([None, 0.04, 0.05, rng.uniform(0, 50)]), rng.choice([None, 10.0, 11.9, 12.0, rng.uniform(0, 30)])) for k in range(rng.randrange(1, 40))] for p in range(30)}
    pages[99] = [(0, "x", 1.0, 10.0), (1, "y", 1.0, 11.0), (2, "z", 0.0, 12.5), (3, "w", 2.0, 11.5)]  # a chain: z is far from the first run
    rows = [(p, *r) for p, runs in pages.items() for r in runs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page int, k int, str string, x double, y double")
    got = {}
    for r in glyphs.page_lines(df, ["page"], "k").orderBy("page", "line").collect():
        got.setdefault(r.page, []).append((r.y, r.text))
    assert got == {p: lines for p, runs in pages.items() if (lines := plain_lines(runs))}
    assert glyphs.page_lines(df.where("false"), ["page"], "k").count() == 0


def test_lines_of_a_page_of_many_runs(spark):
    """Heights are folded, not the lines with all their runs."""
    rng = random.Random(6)
    runs = [(k, rng.choice(["a", "b\u00a0c", "\u3000", "d"]), rng.uniform(0, 500), rng.choice([700.0, 700.6, 698.4, rng.uniform(0, 60)])) for k in range(2500)]
    lines = glyphs.page_lines(spark.createDataFrame([(1, *r) for r in runs], "page int, k int, str string, x double, y double"), ["page"], "k")
    assert [(r.y, r.text) for r in lines.orderBy("line").collect()] == plain_lines(runs)
    assert "aggregate(array_distinct(runs" in lines._jdf.queryExecution().optimizedPlan().toString()


def test_page_text(spark):
    rows = spark.createDataFrame([(0, " a\t\t b\x00\n\n\n\nc "), (1, None), (2, "x" * 30_000)], "k int, t string").orderBy("k")
    assert [r.v for r in rows.select(glyphs.page_text(F.col("t")).alias("v")).collect()] == ["a b\n\nc", "", "x" * 26_000]

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import embed_dup, fingerprints, lm_score, toxicity, url_model
from tessella.llm.common import slices
from tests.llm.helpers import corpus, documents, edited, prose


def test_lm_scores_match_counts(spark):
    rows = corpus()[:70] + [(900, "a b c"), (901, "a b c a b"), (902, None), (None, "a b x")]
    got = collections.defaultdict(list)
    for r in lm_score.lm_scores(documents(spark, rows, extra=True), chunk_words=500).collect():
        got[r["doc_id"]].append(r)
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    grams = lambda w: collections.Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    whole, total = sum((grams(w) for _, w in words), collections.Counter()), sum(len(w) for _, w in words)
    for doc, w in words:
        own, expect = grams(w), 0.0
        seen = lambda g: whole[g] - own[g]  # noqa: B023, E731
        for p in range(len(w)):
            most = min(3, p + 1)
            k = next((k for k in range(most, 1, -1) if seen(tuple(w[p - k + 1 : p + 1]))), 1)
            g = tuple(w[p - k + 1 : p + 1])
            expect += math.log(seen(g) / seen(g[:-1]) if k > 1 else max(seen(g), 1) / (total - len(w))) + math.log(0.4) * (most - k)
        r = got[doc][0]
        assert r["n_words"] == len(w) and r["log_score"] == pytest.approx(expect, rel=1e-9)
        assert r["score"] == (pytest.approx(expect / len(w)) if w else None)


def test_lm_scores_of_one_document_and_none(spark):
    assert lm_score.lm_scores(documents(spark, [(1, "a")]).where("false")).collect() == []
    assert lm_score.lm_scores(documents(spark, [(1, "a b")])).first()["n_words"] == 2


def test_lm_scores_do_not_depend_on_chunks(spark):
    """Also for four words, and with many rows that have no id."""
    rows = corpus()[:60] + [(None, f"{t} tail") for t in ["a b c d e", "b c d e f", "a b c d"] * 9]
    docs = documents(spark, rows).repartition(3)
    found = [sorted((r["n_words"], round(r["log_score"], 6)) for r in lm_score.lm_scores(docs, order=4, chunk_words=n).collect()) for n in (40, 3000, 10**6)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24))
    near = x[:20].repeat(6, axis=0) + rng.normal(size=(120, 24)) * rng.choice([0.05, 0.2, 0.3], size=(120, 1))
    hot = x[50] + rng.normal(size=(150, 24)) * 0.15
    return np.vstack([x, near, hot, x[:5], 3 * x[:5]]).astype(np.float32)


@pytest.mark.parametrize("panel", [16_384, 40])
def test_embedding_links_match_brute_force(spark, panel):
    x = vectors()
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1001, [0.0] * 24, ""), (1002, [float("nan")] + [1.0] * 23, ""), (1003, [None] + [1.0] * 23, ""), (1004, [float("inf")] * 24, ""), (1005, [], ""), (1006, [1.0, 2.0], ""), (1007, [2.0, 4.0], ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, low string")
    got = {r["vec_id"]: r for r in embed_dup.embedding_duplicates(df, panel=panel, sample=100).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    link = d @ d.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), label[i], label[i] == i)
    assert [got[k]["n_links"] for k in range(1000, 1008)] == [0] * 6 + [1, 1] and got[1007]["component_id"] == 1006
    assert got[None]["n_links"] == 0 and got[None]["kept"]
    assert embed_dup.embedding_duplicates(df.where("false")).collect() == []


def test_fingerprint_edits_match_plain_version(spark):
    rows = corpus() + [(500, "ab"), (501, "abc"), (502, "🙂🙂🙂é")]
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(spark, rows, extra=True), rows=17).collect()}
    assert len(got) == len(rows)
    order = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    prints = {r[1] or "": got[r[0]]["fingerprint"] for r in rows}
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]]):
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        parts = lambda x: [x[k : k + 4] for k in range(0, len(x), 4)]
        alike = lambda x, y: sum(a == b for a, b in zip(parts(x), parts(y), strict=True)) / fingerprints.SAMPLES
        assert r["near_edited"] == alike(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == alike(r["fingerprint"], prints[after])
        if changed == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r[1] or ""].add(got[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({got[r[0]]["fingerprint"] for r in rows if r[1] and len(r[1]) > 100}) > 30


def test_fingerprint_of_few_rows(spark):
    assert fingerprints.fingerprint_edits(documents(spark, [(1, "a")]).where("false")).collect() == []
    one = fingerprints.fingerprint_edits(documents(spark, [(1, "abc")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(1, 1.0)]
    many = fingerprints.fingerprint_edits(documents(spark, [(1, "abc"), (1, "abc"), (None, None), (None, "q")]), rows=1).collect()
    assert len(many) == 4
    # rows without an id come last, in falling order of their texts' md5, whatever ranges they are in
    rows = [(2, "two words"), *((None, prose(k, 9)) for k in range(30))]
    found = {r["edited_sha256"] for r in fingerprints.fingerprint_edits(documents(spark, rows), rows=4).collect()}
    order = ["two words", *sorted((t for d, t in rows if d is None), key=lambda t: hashlib.md5(t.encode()).hexdigest(), reverse=True)]
    assert found == {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for t, u in zip(order, [*order[1:], order[0]])}


def test_collision_rate_is_generalised_jaccard():
    base = prose(1, 600)
    texts = [base, *(edited(base, s, 4 * s) for s in range(1, 12)), base + " " + base]
    (_, flat, at), = slices(pa.array(texts), 1 << 30)
    marks = fingerprints.signatures(flat, at, samples=512)
    bags = []
    for t in texts:
        w = t.split(" ")
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    for k in range(1, len(texts)):
        keys = bags[0].keys() | bags[k].keys()
        want = sum(min(bags[0][x], bags[k][x]) for x in keys) / sum(max(bags[0][x], bags[k][x]) for x in keys)
        assert abs(fingerprints.likeness(marks[:1], marks[k : k + 1])[0] - want) < 0.09


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice(["", "s", "ing"]) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["zorblat", f"krumpf{rng.choice(['en', 'er', 'ung', 'e'])}"])
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:])))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "Zorblat!"), (2003, "you idiot"), (None, "x"), (2004, " ".join(["alpha"] * 30_000))]
    labels += [(None, 1, 1), (5, 1, None)]
    docs, known = documents(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(got[d]["predicted"], t) for d, _, t in labels if d is not None and got[d]["held_out"] and t is not None]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert got[2002]["predicted"] == got[2003]["predicted"] == 1 and got[2000]["score"] == got[2001]["score"] == got[2004]["score"] < 0.3
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F

    other = known.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, other).collect()}
    assert again == {d: r["score"] for d, r in got.items()}
    none = toxicity.toxicity(docs.where("false"), known.where("false"))
    assert none.collect() == []
    kept = toxicity.rejected(docs, toxicity.fit(docs, known), keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got.values())


def test_grammar_marks_clauses():
    """The composed machine against a plain reading of every clause of up to five words."""
    machine = toxicity.grammar()
    O, I, H, T, N, R = toxicity.OTHER, toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT  # noqa: E741

    def plain(c):
        hits = [k for k, x in enumerate(c) if x in (I, H)]
        near = any(T in c[max(0, k - 5) : k] or T in c[k + 1 : k + 3] for k in hits)
        negated, reported = any(N in c[max(0, k - 3) : k] for k in hits), any(R in c[:k] for k in hits)
        threat = H in c and (near or I not in c)
        return 8 * threat + 4 * near + 2 * negated + reported

    for n in range(1, 6):
        for c in itertools.product(range(6), repeat=n):
            assert toxicity.match(machine, list(c), [1.0] * n) == (plain(list(c)), n), c
    rng = random.Random(2)
    for _ in range(3000):
        c = [rng.choice([O, O, O, O, I, H, T, N, R]) for _ in range(rng.randint(6, 14))]
        assert toxicity.match(machine, c, [0.0] * len(c))[0] == plain(c), c


def test_calibration_learns_patterns():
    """Rows whose one clause pattern is always innocent get a weight near 0 for it, others keep theirs."""
    rng = np.random.default_rng(5)
    x, y = np.zeros((600, 16)), np.zeros(600)
    x[:200, 0], y[:200] = rng.uniform(3, 6, 200), 1
    x[200:400, 1] = rng.uniform(3, 6, 200)
    offset, weights = toxicity.calibrate(x, y)
    assert weights[0] > 0.5 > 0.15 > weights[1] and weights[9] == toxicity.PRIOR[9] and offset < -1


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://Example.COM/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"), ("http://a.com/", "a.com", "/", "com/", "allow"), ("http://a.com", "a.com", "", None, None),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"), ("http://x.net/en/", "x.net", "/en/", None, None),
        ("http://notcom/", "notcom", "/", None, None), ("http://com/a", "com", "/a", "com/", "allow"), ("a://b://c/d", "b:", "//c/d", None, None), ("none", "", "", None, None), (None, "", "", None, None),
        ("x://", "", "", None, None), ("http://h?x/y", "h", "", None, None), ("http://ÄB.com/É", "Äb.com", "/É", "com/", "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    got = url_model.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (got["host"], got["path"], got["rule"]) == (host, path, rule)
    assert got["verdict"] == verdict if verdict else got["verdict"] in ("allow", "block")


def test_url_model_tells_sites_apart(spark):
    rng = random.Random(4)
    good = lambda: f"http://{rng.choice(['news', 'wiki', 'docs'])}{rng.randrange(99)}.example.{{}}/article/{rng.randrange(10**5)}"
    bad = lambda: f"http://{rng.choice(['casino', 'slots', 'pills'])}{rng.randrange(99)}.example.{{}}/win/{rng.randrange(10**5)}"
    rows = [(i, (good if i % 2 else bad)().format("com" if i % 2 else "bad") if i < 800 else (good if i % 2 else bad)().format("org"), "x") for i in range(1000)]
    pages = spark.createDataFrame([*rows, (2000, None, "")], "page_id long, url string, host string")
    rules = [("com", "/", "allow"), ("bad", "/", "block")]
    got = {r["page_id"]: r for r in url_model.judge(pages, rules=rules).collect()}
    free = [(got[i]["verdict"] == "allow") == bool(i % 2) for i in range(800, 1000)]
    assert sum(free) / len(free) > 0.95 and got[2000]["host"] == ""
    assert url_model.judge(pages.where("false")).collect() == []


def test_chances_add_up_to_one():
    """The mixture of hashed counts is a distribution while slots don't collide."""
    texts = pa.array(["abcab", "abd", "xyz"])
    row, context, both = url_model._grams(texts, 3, 20)
    counts = np.zeros((2, 2, 1 << 20))
    counts[0, 1], counts[1, 1] = (np.bincount(x.ravel(), minlength=1 << 20) for x in (context, both))
    total = sum(math.exp(-url_model.ratios(pa.array([chr(c)]), -counts * 0, 3, 20, 2.0)[0]) for c in range(97, 100))
    assert total == pytest.approx(3.0)
    assert url_model.ratios(texts, counts, 3, 20, 2.0).min() > 0


def test_url_counts_are_exact(spark):
    """With more contexts than any fixed table was made for, each ratio is that of counts in plain dicts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(rng.randint(8, 30)))
    rows = [(i, f"http://{word()}.{'com' if i % 3 == 0 else 'bad' if i % 3 == 1 else 'org'}/{word()}") for i in range(6000)] + [(6000, None), (6001, "http://\u00e9.com/\u00df")]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_model.judge(pages, rules=[("com", "/", "allow"), ("bad", "/", "block")]).collect()}
    text = {i: (u or "").removeprefix("http://") for i, u in rows}
    folds = {r["page_id"]: r["f"] for r in spark.createDataFrame(list(text.items()), "page_id long, t string").selectExpr("page_id", "pmod(xxhash64(t), 5) as f").collect()}
    grams = lambda t: [(tuple(b[j - k : j]), b[j]) for b in [[0] * url_model.ORDER + [x + 2 for x in t.encode()] + [1]] for j in range(url_model.ORDER, len(b)) for k in range(url_model.ORDER + 1)]
    seen, met = ({"allow": collections.Counter(), "block": collections.Counter()} for _ in range(2))
    for i, t in text.items():
        if got[i]["rule"] and folds[i]:
            for context, byte in grams(t):
                seen[got[i]["verdict"]][context] += 1
                met[got[i]["verdict"]][context, byte] += 1
    for i in [*range(0, 6000, 7), 6000, 6001]:
        logs = dict.fromkeys(seen, 0.0)
        for v in logs:
            chance = 1 / 258
            for context, byte in grams(text[i]):
                chance = (met[v][context, byte] + url_model.SMOOTHING * (chance if context else 1 / 258)) / (seen[v][context] + url_model.SMOOTHING)
                logs[v] += math.log(chance) if len(context) == url_model.ORDER else 0
        assert got[i]["ratio"] == pytest.approx((logs["allow"] - logs["block"]) / (len(text[i].encode()) + 1), abs=1e-9), i

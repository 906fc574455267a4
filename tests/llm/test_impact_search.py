"""Bit-sliced search against plain scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import impact_search as search
from tests.llm.helpers import documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for x in terms for t in set(x))
    counts, out = [Counter(x) for x in terms], []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(LOWER)), []
        for (doc, _), tf, x in zip(docs, counts, terms):
            score = 0
            for t in asked:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * (100 - 75 + (75 * len(x) * n_docs) // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


def tables(spark, docs, items):
    wide = documents(spark, docs, extra=True).withColumn("score", F.lit("x")).withColumn("rank", F.lit("y")).withColumn("query", F.lit("z")).repartition(5)
    return wide, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)).repartition(2)


def found(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


@pytest.fixture(scope="module")
def small():
    docs = [(k, prose(k % 25, 5 + 3 * (k % 40), words=80) + (" Common" if k % 3 else " common COMMON x9")) for k in range(300)]
    docs += [(None, "common"), (400, None), (401, ""), (402, " .,- "), (403, "Éa éa ÉA 漢字 common"), (404, prose(3, 20_000, words=80)), (404, "common x9"), (405, "y" * 20_000)]
    random.Random(1).shuffle(docs)
    items = [(k, prose(k, 12, words=80)) for k in range(20)] + [(20, "common"), (21, "common x9 X9 common common"), (22, None), (23, ""), (24, "nowhereatall"), (25, "éa 漢字"), (25, "ÉA"), (None, "common"), (26, "y" * 20_000)]
    return docs, items


def test_ranks_equal_plain_ones(spark, small, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(search, "KEPT_TERMS", 4)
    assert found(search.ranked(*tables(spark, *small))) == sorted(map(repr, plain(*small)))


def test_batches_of_queries_give_the_same(spark, small, monkeypatch):
    monkeypatch.setattr(search, "BATCH_ENTRIES", 60)
    assert found(search.ranked(*tables(spark, *small), k=3)) == sorted(map(repr, plain(*small, k=3)))


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a"), (2, None)], []), ([(1, None)], [(1, "a")]), ([(1, "a a"), (2, "a"), (3, "b")], [(7, "a b")])])
def test_small_and_empty_tables(spark, docs, items):
    wide = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert found(search.ranked(*wide)) == sorted(map(repr, plain(docs, items)))


@given(st.lists(st.lists(st.integers(0, 2**40), min_size=130, max_size=130), min_size=1, max_size=5), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_slices_add_and_give_the_highest(columns, k):
    words, total = 3, []
    for c in columns:
        search.carry_add(total, [np.concatenate([b, np.zeros(words - len(b), "<u8")]) for b in search.sliced(np.array(c))] if any(c) else [], words)
    sums = np.sum(np.array(columns), axis=0)
    assert search.sums_at(total, np.arange(130)).tolist() == sums.tolist()
    rows = search.highest(total, words, k).tolist()
    assert sorted(rows) == sorted(sorted(np.flatnonzero(sums).tolist(), key=lambda r: (-sums[r], r))[:k])

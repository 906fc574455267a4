import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, queries
from tests.llm.helpers import documents, edited, prose


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_schedule_keeps_deadlines_and_shares(n):
    rng = random.Random(n)
    weights = {f"s{i}": rng.random() ** 3 for i in range(n)}
    parts = mixing.shares(weights, 500)
    assert sum(parts.values()) == 500
    done = dict.fromkeys(parts, 0)
    for source, k, release, due, slot in sorted(mixing.pfair(parts, 500), key=lambda x: x[4]):
        assert release <= slot < due and k == done[source]
        done[source] += 1
        assert all(abs(done[s] - (slot + 1) * parts[s] / 500) < 1 for s in parts)
    assert done == parts


def test_shares_of_odd_weights():
    assert mixing.shares({}) == {}
    assert mixing.shares({"a": 1, "b": 0}, 10) == {"a": 10, "b": 0}
    assert mixing.shares({"a": 1e9, "b": 1e-9}, 10) == {"a": 9, "b": 1}
    with pytest.raises(ValueError):
        mixing.shares({"a": 0.0})


def test_mix_matches_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 40), rng.choice(["hot", "hot", "hot", "a", "b", "c"])) for i in range(900)] + [(None, "yy", "alone"), (7, "zz", None), (7, None, "unweighted")]
    docs = documents(spark, rows, extra=True)
    weights, block, period = {"hot": 2.0, "a": 1.0, "b": 1.0, "c": 3.0, "": 0.01, "absent": 1.0}, 50, 100
    size = F.length("text")
    got = mixing.schedule(docs, weights, block, period, size=size, range_rows=100).collect()
    assert len(got) == len(rows)
    hashed = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(size, F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h_")).collect()
    by = defaultdict(list)
    for r in hashed:
        by[r["source"]].append((r["h_"], r["doc_id"] is not None, r["doc_id"] or 0, r["n"]))
    parts = mixing.shares(weights, period)
    table = {(s, k): slot for s, k, _, _, slot in mixing.pfair(parts, period)}
    slot_of = lambda s, k: k // parts[s] * period + table[s, k % parts[s]]
    stop = min(slot_of(s, -(-sum(x[3] for x in v) // block)) for s, v in by.items() if parts.get(s))
    expect = []
    for s, v in by.items():
        before = 0
        for _, known, d, n in sorted(v):
            k = before // block
            slot = slot_of(s, k) if parts.get(s) else None
            expect.append((d if known else None, s, n, k, slot, slot is not None and slot < stop))
            before += n
    assert sorted(map(str, expect)) == sorted(str((r["doc_id"], r["source"], r["units"], r["block_no"], r["slot"], r["in_mix"])) for r in got)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got if r["slot"] is not None)


def test_schedule_keeps_to_the_true_weights():
    """Over the whole schedule, longer than the shortest period, no source is two blocks away from its weight."""
    rng = random.Random(8)
    sizes = {f"s{i}": rng.randint(1, 4000) for i in range(60)} | {"hot": 40_000, "one": 1}
    weights = {s: n**0.5 for s, n in sizes.items()}
    period = mixing.period_for(sizes, weights, 1)
    assert period > 10 * mixing.PERIOD
    total, done, worst = sum(weights.values()), dict.fromkeys(sizes, 0), 0.0
    for i, (source, *_, slot) in enumerate(sorted(mixing.pfair(mixing.shares(weights, period), period), key=lambda x: x[4])):
        done[source] += 1
        if i % 97 == 0:
            worst = max(worst, *(abs(done[s] - (slot + 1) * weights[s] / total) for s in sizes))
    assert worst < 2


def test_more_sources_than_the_shortest_period(spark):
    docs = spark.createDataFrame([(i, f"s{i % 10_500}") for i in range(11_000)], "doc_id long, source string")
    sizes, weights = mixing.source_sizes(docs), mixing.tempered_weights(docs)
    assert len(weights) == 10_500
    got = mixing.schedule(docs, weights, 1, mixing.period_for(sizes, weights, 1))
    assert got.where("slot is null").count() == 0 and got.select("slot").distinct().count() == 11_000


def test_mix_of_nothing(spark):
    docs = documents(spark, [(1, "a")]).where("false")
    assert mixing.tempered_weights(docs) == {}
    assert mixing.schedule(docs, {"a": 1.0}, 10).collect() == []


def plain_best_fit(pieces, capacity, per_source):
    """Largest first; of all bins that fit and have no conflict the one with the least room, then the oldest."""
    bins, out = [], []
    for n, source, cluster in pieces:
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= n and b["sources"].count(source) < per_source and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"used": 0, "sources": [], "clusters": set()})
        b = bins[i]
        out.append((i, b["used"]))
        b["used"] += n
        b["sources"].append(source)
        b["clusters"].add(cluster)
    return out


@pytest.mark.parametrize("per_source", [1, 2, 3])
def test_bins_match_plain_version(per_source):
    rng = random.Random(per_source)
    pieces = sorted(((rng.randint(1, 60), rng.choice("aaabcd"), rng.choice(range(40))) for _ in range(400)), key=lambda p: -p[0])
    bins = packing.Bins(100, per_source)
    got = [bins.put(n, 1 << "abcd".index(s), 1 << c) for n, s, c in pieces]
    assert got == plain_best_fit(pieces, 100, per_source)


def test_packing_places_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 300) if i % 50 else 2500, rng.choice(["hot", "hot", "a", "b"]), rng.choice([None, 1, 2, 3, *range(10, 400)])) for i in range(600)]
    rows += [(None, 10, None, None), (None, None, None, 5), (5, 20, "a", 9), (5, 20, "a", 9)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long").withColumn("shard", F.lit("clash")).withColumn("length", F.lit("x"))
    got = packing.best_fit(items, capacity=1000, shard_rows=150).collect()
    want = defaultdict(int)
    for d, n, *_ in rows:
        want[d] += max(n or 1, 1)
    have, used, spans = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        have[r["doc_id"]] += r["n_tokens"]
        used[r["bin_id"]] += r["n_tokens"]
        spans[r["bin_id"]].append((r["bin_offset"], r["n_tokens"], r["doc_id"]))
    assert want == have and max(used.values()) <= 1000
    source, cluster = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for members in spans.values():
        members.sort(key=lambda m: m[0])
        assert all(a[0] + a[1] == b[0] for a, b in zip(members, members[1:])) and members[0][0] == 0
        ids = [m[2] for m in members if m[2] not in (None, 5)]
        assert len(ids) == len(set(ids))
        assert all([source[d] for d in ids].count(s) <= 2 for s in {source[d] for d in ids})
        held = [cluster[d] for d in ids if cluster[d] is not None]
        assert len(held) == len(set(held))
    assert packing.best_fit(items.where("false")).collect() == []


def test_rows_without_id_and_cluster_share_a_bin(spark):
    items = spark.createDataFrame([(None, 10, f"s{i}", None) for i in range(3)], "doc_id long, n_tokens long, source string, cluster long")
    assert len({r["bin_id"] for r in packing.best_fit(items, capacity=100).collect()}) == 1


def test_equal_rows_are_dealt_to_many_shards(spark):
    items = spark.range(2000).selectExpr("cast(null as long) as doc_id", "30L as n_tokens", "'s' as source", "cast(null as long) as cluster").repartition(4)
    sizes = packing.best_fit(items, capacity=100, shard_rows=100).groupBy("shard").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 200


def test_near_copies_never_share_a_sequence(spark, tmp_path):
    bases = [prose(i, 100) for i in range(3)]
    texts = [edited(bases[i % 3], i, 1) for i in range(12)] + [bases[0], bases[0], None, ""]
    documents(spark, [(i if i != 13 else None, t, f"s{i}") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    bins = defaultdict(list)
    for r in queries.op6_packing(spark, str(tmp_path)).collect():
        bins[r["bin_id"]].append(13 if r["doc_id"] is None else r["doc_id"])
    group = lambda i: i % 3 if i < 12 else 0 if i < 14 else "blank"
    assert sorted(i for held in bins.values() for i in held) == list(range(16))
    assert all(len({group(i) for i in held}) == len(held) for held in bins.values()) and len(bins) == 6


def test_equal_texts_but_for_the_case_of_any_letter_never_share_a_sequence(spark, tmp_path):
    texts = ["École d'été à Paris", "ÉCOLE  D'ÉTÉ À PARIS ", "plain words here", "PLAIN words\nhere", "other words", "\t", None]
    documents(spark, [(i, t, f"s{i}") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    held = defaultdict(set)
    for r in queries.op6_packing(spark, str(tmp_path)).collect():
        held[r["bin_id"]].add(r["doc_id"])
    assert sorted(i for ids in held.values() for i in ids) == list(range(7))
    assert not any({a, a + 1} <= ids for ids in held.values() for a in (0, 2, 5)) and len(held) == 2

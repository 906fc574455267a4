"""The pipeline, each stage held against a plain version on its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing
from tests.llm.helpers import documents, edited, prose

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and 0 < out.count() <= before
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_near_duplicate_stage_keeps_the_first(spark):
    base = prose(9, 200)
    rows = [(5, base), (3, edited(base, 1, 2)), (8, prose(10, 80)), (8, prose(10, 80)), (None, base), (9, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [3, 8, 9]
    assert kept.where("doc_id is null").count() == 1


def test_different_texts_of_one_id_are_told_apart(spark):
    a, b = prose(20, 120), prose(21, 120)
    rows = [(8, a), (8, b), (8, b), (8, None), (9, edited(b, 1, 1)), (5, edited(a, 2, 1)), (12, prose(22, 90))]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in kept if r["text"] is None or r["doc_id"] in (5, 12)) == [5, 8, 12]
    rest = [(r["doc_id"], r["text"]) for r in kept if r["text"] is not None and r["doc_id"] not in (5, 12)]
    assert len(rest) == 1 and rest[0] in [(8, b), rows[4]]  # one of the two copies of b; a goes as 5 is its copy


def test_mix_stage_has_target_shares(spark):
    rows = [(i, "x" * 70_000, "hot" if i % 3 else f"s{i % 6}") for i in range(120)]
    docs = documents(spark, rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    share = {s: sum(r["source"] == s for r in mixed) / len(mixed) for s in ("hot", "s0", "s3")}
    weights = mixing.tempered_weights(docs)
    for s in share:
        assert abs(share[s] * len(mixed) - weights[s] / sum(weights.values()) * len(mixed)) < 3
    assert corpus_pipeline.mix_sources(spark, docs.where("false"), "").collect() == []


def test_mixing_stage_keeps_every_document(spark):
    """One tiny source doesn't end the mix; null ids, equal ids and sources without text stay."""
    rows = [(i, "x" * 70_000, "hot" if i % 3 else "even") for i in range(60)] + [(100, "tiny", "tiny"), (None, "a", "even"), (None, "a", "even"), (None, "b", None), (7, "other", "hot"), (200, "", "blank"), (201, None, "blank")]
    docs = documents(spark, rows)
    mixing_stage = dict(corpus_pipeline.STAGES)["mixing"]
    mixed = mixing_stage(spark, docs, "").collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, docs.collect()))
    assert {r["source"] for r in mixed[-2:]} == {"blank"}
    weights = mixing.tempered_weights(docs, size=F.length("text"))
    part = weights["hot"] / (weights["hot"] + weights["even"])
    long = [r["source"] for r in mixed if len(r["text"] or "") > 100]
    both = long[: len(long) - long[::-1].index("even")]  # up to the end of the smaller of the two
    assert both.count("hot") < 40 and all(abs(both[:n].count("hot") - part * n) < 2.5 for n in range(1, len(both)))
    assert mixing_stage(spark, docs.where("false"), "").collect() == []


def test_packing_follows_the_mix(spark, tmp_path):
    """Sequences come in the order of the rows before, also when those were written and read back."""
    rows = [(1000 - i, prose(i, 40), f"s{i % 9}") for i in range(300)]
    docs = documents(spark, rows).repartition(5)
    wanted = docs.withColumn("k", F.expr("hash(doc_id)")).orderBy("k")
    wanted.drop("k").write.parquet(str(tmp_path / "docs"))
    order = {r["doc_id"]: i for i, r in enumerate(wanted.collect())}
    packed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted(order)
    first = {}
    for r in packed:
        key = (r["shard"], r["bin"])
        first[key] = min(first.get(key, 10**9), order[r["doc_id"]])
    assert [first[k] for k in sorted(first)] == sorted(first.values())

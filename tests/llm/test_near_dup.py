import pytest

from tessella.llm.components import connected_components
from tessella.llm.near_dup import near_duplicates
from tests.llm.helpers import corpus, documents, edited, prose


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent=80):
    sets = {r[0]: shingles(r[1], width) for r in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_matches_brute_force(spark, width):
    rows = corpus()
    got = near_duplicates(documents(spark, rows, extra=True), width=width).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_of_distant_copies(spark):
    """Copies that are linked with their origin only, and others with nothing: as many as a bucket may hold."""
    base = prose(3, 130)
    rows = [(10 + i, edited(base, i, 1 + i % 9)) for i in range(250)] + [(5000, base)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(documents(spark, rows), width=5).collect()}
    assert got == brute(rows, 5)


def test_nulls_repeats_and_empty(spark):
    text = prose(1, 50)
    rows = [(None, text), (4, text), (4, text), (2, text), (9, None), (None, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 2, False), (4, 2, False), (2, 2, True), (9, 9, True), (None, None, True)], key=str)
    empty = near_duplicates(documents(spark, rows).where("false"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_different_texts_under_one_id(spark):
    a, b = prose(30, 90), prose(31, 90)
    rows = [(5, a), (5, b), (3, edited(a, 1, 1)), (2, edited(b, 2, 1)), (8, prose(32, 70)), (8, None), (9, b)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(documents(spark, rows)).collect())
    n = lambda t: len(shingles(t, 5))
    assert got == sorted([(5, n(a), 3, False), (5, n(b), 2, False), (3, n(rows[2][1]), 3, True), (2, n(rows[3][1]), 2, True), (8, n(rows[4][1]), 8, True), (8, 0, 8, True), (9, n(b), 2, False)])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 200), (None, 3), (149, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 60 for k in range(100, 150)}, 60: 60, 200: 200}

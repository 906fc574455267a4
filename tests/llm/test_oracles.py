"""Registered queries against plain SQL where there is some, and their shapes."""

import pytest

from tessella.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLES[name]) > 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_token_files", "op7_mixing", "op9_fingerprints", "op10_lm_score"])
def test_query_has_a_row_for_every_document(spark, name):
    sf = "/root/testdata/sf0.001"
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, sf).select("doc_id").collect()) == ids

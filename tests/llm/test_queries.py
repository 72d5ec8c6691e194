"""Registered queries against their SQL, and the pipeline's stages against plain rules."""

from __future__ import annotations

import corpus_pipeline
import pytest
from tests.compare import differences
from tests.llm import brute

from tickloom.llm.queries import QUERIES, SQL, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, SF, QUERIES[name], SQL[name]) == ""


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    assert good.columns == columns and 0 < good.count() <= docs.count()
    one = corpus_pipeline.near_duplicates(spark, good, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in brute.components(rows, 5, 80)})
    clean = corpus_pipeline.decontaminate(spark, one, SF).cache()
    assert clean.columns == columns and clean.count() <= one.count()
    mixed = corpus_pipeline.mix(spark, clean, SF).cache()
    assert mixed.columns == columns
    words, whole = (sum(len(brute.words(r["text"])) for r in x.collect()) for x in (mixed, clean))
    assert abs(words - 1.5 * whole) < 0.1 * whole
    out = corpus_pipeline.token_ids(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and max(r["start"] + r["n_tokens"] for r in out) == sum(r["n_tokens"] for r in out)

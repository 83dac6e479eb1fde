"""Every named query of the training-data operators on the smallest test tables."""

from pathlib import Path

import pytest

queries = pytest.importorskip("sluiceway.llm.queries")
BASE = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not BASE.exists(), reason="no test tables")

COLUMNS = {
    "p1_found": {"rec_a": "bigint", "rec_b": "bigint"},
    "p2_found": {"row_id": "bigint", "kind": "string"},
    "p3_found": {"field": "string", "rec_id": "bigint", "kind": "string", "nth": "bigint"},
    "p4_found": {"field": "string", "term": "string", "mark": "string"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(BASE))
    rows = df.collect()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        assert len(rows) == len(set(rows))
    if name == "p1_found":
        assert all(r.rec_a < r.rec_b for r in rows)


def test_corpus_and_found_share_the_documents(spark):
    n = spark.read.parquet(str(BASE / "documents.parquet")).count()
    assert queries.QUERIES["p8_corpus"](spark, str(BASE)).count() + queries.QUERIES["p8_found"](spark, str(BASE)).count() == n

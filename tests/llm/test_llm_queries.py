"""The queries of the subpackage run on the smallest tables with the columns asked for."""

import pytest

from quillgraph.llm import queries

COLUMNS = {
    "p1_found": ["doc_id"], "p2_found": ["first_doc_id", "doc_id"], "p3_found": ["first_id", "id"], "p4_found": ["table_name", "row_key", "field_name"],
    "p6_found": ["run_id", "document_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() > 0


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"p{i}" for i in (1, 2, 3, 4, 6, 7, 8, 9)}

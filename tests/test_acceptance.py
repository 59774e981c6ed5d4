"""Reasons, bases and codes of candidates and documents, case by case."""

import json

from pyspark.sql import functions as F

from quillgraph.functions import ids
from quillgraph.operators import acceptance

FIELDS = "title string, abstract string, content string, keywords array<string>, snippets array<string>, source_name string, source_record_id string, access_basis string, query_text string, source_codes array<string>, search_rank string, has_authors boolean, clc_code string, terms array<string>"
BASE = {"title": "甲病概说", "abstract": None, "content": "关于头痛疾病的说明。" * 5, "keywords": None, "snippets": None, "source_name": "other", "source_record_id": "1", "access_basis": "open", "query_text": "CLC=R5", "source_codes": None, "search_rank": None, "has_authors": False, "clc_code": "R5", "terms": ["头痛"]}
CASES = [
    ({"title": " "}, "missing_title"), ({"content": "短"}, "text_too_short"), ({"source_record_id": None}, "missing_source_identity"), ({"source_name": ""}, "missing_source_identity"), ({"access_basis": ""}, "missing_access_basis"),
    ({"source_name": "cnki", "query_text": "CLC=R51"}, "cnki_query_missing_target_clc_code"), ({"source_codes": ["R74"]}, "source_clc_conflict"), ({"source_codes": ["[R]"]}, None), ({"source_name": "mediawiki", "terms": ["骨折"]}, "query_terms_not_found"),
    ({"source_name": "mediawiki", "terms": ["头痛疾病学"]}, None), ({"terms": ["头痛疾病学"]}, None), ({"source_name": "mediawiki", "terms": ["骨折"], "search_rank": "7", "content": "健康与疾病的说明。" * 9}, None),
    ({"source_name": "mediawiki", "terms": ["骨折"], "search_rank": "7", "content": "健康与疾病的说明。" * 9, "title": "甲医院"}, "query_terms_not_found"), ({"source_name": "mediawiki", "terms": ["骨折"], "search_rank": "101", "content": "健康与疾病的说明。" * 9}, "query_terms_not_found"),
    ({"source_name": "mediawiki", "terms": ["骨折"], "snippets": ["骨折"]}, None), ({"source_name": "cnki", "terms": ["骨折"]}, "cnki_unverified_no_term_match"), ({"source_name": "cnki", "terms": None, "source_codes": ["R51"]}, None), ({"source_name": "cnki"}, None), ({"content": "", "abstract": "头痛" * 30}, None),
]


def test_reasons(spark):
    rows = [tuple((BASE | c).values()) for c, _ in CASES]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, " + FIELDS)
    got = {r.k: r for r in acceptance.judged(df, 20).collect()}
    assert [got[i].reason for i in range(len(CASES))] == [w for _, w in CASES]
    basis = lambda i: (got[i].basis, got[i].confidence)
    assert basis(9) == ("query_term_match", 0.62) and basis(11) == ("mediawiki_ranked_search_mapping", 0.45) and basis(16) == ("source_metadata", 0.98) and basis(17) == ("cnki_batch_query_mapping", 0.8)
    assert got[16].relevance == 0.98 and got[17].relevance == 0.66 and acceptance.judged(df.limit(0), 20).count() == 0


def document(**changes):
    d = {"schema_version": "1.0", "document_id": "doc_" + "a" * 24, "source": {"name": "x", "record_id": "1"}, "bibliography": {"title": "t"}, "text": {"content": "c", "content_hash": "sha256:2e7d2c03a9507ae265ecf5b5356885a53393a2029d241394997265a1a25aefc6"}, "classifications": [{"category_id": "k", "clc_code": "R1"}], "provenance": [{}], "collection": {"pipeline_version": "1.3"}}
    return json.dumps(d | changes)


def test_codes(spark):
    bad = [{"category_id": "k", "clc_code": "R2"}, 5, {"category_id": "z", "clc_code": "Q1"}]
    cases = [
        (document(), ""), (document(classifications=bad), "clc_code_mismatch,invalid_classification,unknown_category,not_clc_r"), (document(classifications=[]), "missing_classification"), (document(classifications="x"), "missing_classification"), (document(provenance=[], collection=3), "missing_provenance,invalid_collection"),
        (document(collection={}), "unsupported_pipeline_version"), (document(schema_version="2", document_id="d", source=None), "unsupported_schema_version,invalid_document_id,invalid_source"), (document(text={"content": " ", "content_hash": "q"}), "missing_content"), (document(text={"content": "c"}), "content_hash_mismatch"),
        (None, "unsupported_schema_version,invalid_document_id,invalid_source,missing_title,missing_content,missing_classification,missing_provenance,invalid_collection"),
    ]
    df = spark.createDataFrame([("r", str(i), j, "e") for i, (j, _) in enumerate(cases)] + [("r", "again", cases[1][0], "e")], "run_id string, document_id string, canonical_json string, errors string")
    cat = spark.createDataFrame([("k", "R1")], "category_id string, clc_code string")
    got = {r.document_id: r.errors for r in acceptance.validation_errors(df, cat).collect()}
    assert got == {str(i): w for i, (_, w) in enumerate(cases)} | {"again": cases[1][1]}
    assert acceptance.validation_errors(df.limit(0), cat).count() == 0


def test_urls_have_one_spelling_of_escapes(spark):
    rows = [("HTTP://A.b/x/?b=%e7%97%85&a=1+2&utm_x=1#f", "http://a.b/x?a=1+2&b=%E7%97%85"), ("https://a.b?q=病&~=*", "https://a.b/?q=%E7%97%85&~=%2A"), ("ftp://A/x", "ftp://A/x"), (None, ""), ("http://a.b/?x=%zz&y", "http://a.b/?x=%25zz&y=")]
    df = spark.createDataFrame([(u, w) for u, w in rows], "u string, w string")
    for r in df.select(ids.canonical_url(F.col("u")).alias("g"), "w").collect():
        assert r.g == r.w

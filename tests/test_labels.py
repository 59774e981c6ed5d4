"""Label datasets against their rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import labels


def test_gold_labels(spark):
    rows = [("头痛服药片", [(0, 1, "sym"), (1, 2, "dru"), (3, 4, "dru")]), ("无", [(0, 0, "bod")]), ("长" * 501, [(0, 0, "dis")]), ("", []), ("甲病", [(0, 5, "dis"), (-1, 0, "dis"), (0, 1, "dis")]), ("空", None)]
    df = spark.createDataFrame([(t, e, 1) for t, e in rows], "text string, entities array<struct<start:int,end:int,type:string>>, labels int")
    got = {r.sentence: r.labels for r in labels.gold_dataset(df).collect()}
    assert got == {"头痛服药片": ["B-Symptom", "I-Symptom", "O", "B-Drug", "I-Drug"], "甲病": ["B-Disease", "I-Disease"]}
    assert labels.gold_dataset(df.limit(0)).count() == 0


def test_weak_labels(spark):
    terms = [("头痛", "Symptom"), ("痛风", "Disease"), ("头", "Part"), ("", "Part")]
    assert labels.weak_labels("头痛风头", terms) == ["B-Symptom", "I-Symptom", "O", "B-Part"]
    assert labels.weak_labels("痛风头痛", [("风头", "X"), ("痛风", "Disease")]) == ["B-Disease", "B-X", "I-X", "O"]
    df = spark.createDataFrame([(1, 0, "头痛风头"), (1, 1, "无事"), (2, 0, ""), (3, 0, None)], "doc_id long, pos int, sentence string")
    assert [(r.doc_id, r.labels) for r in labels.weak_dataset(df, terms).collect()] == [(1, ["B-Symptom", "I-Symptom", "O", "B-Part"])]


def test_review_dataset(spark):
    rows = [
        (1, "甲病", "Disease", "头痛", "Symptom", " 甲病可见头痛。"), (2, "甲病", "Disease", "痛", "Symptom", "甲病可见头痛。"), (3, "甲病", "Disease", "头痛", "Symptom", "甲病可见头痛。"),
        (4, "甲病", "Disease", "科", "Department", "甲病可见头痛。"), (5, "甲病", "Disease", "头痛", "Symptom", "  "), (6, None, "Disease", "没有", "Symptom", "别的话。"), (7, "甲病", None, "头痛", "Symptom", None),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id long, subject string, subject_type string, object string, object_type string, source_text string, labels int")
    got = {r.sentence: (r.labels, r.source_ids) for r in labels.review_dataset(df).collect()}
    assert got == {"甲病可见头痛。": (["B-Disease", "I-Disease", "O", "O", "B-Symptom", "I-Symptom", "O"], [1, 3]), "别的话。": (["O"] * 4, [])}
    assert {r.reason: r.n for r in labels.review_skips(df).collect()} == {"Disease/Department": 1, "?/Symptom": 1, "no evidence": 1}
    assert {r.type: r.n for r in labels.label_histogram(labels.review_dataset(df)).collect()} == {"Disease": 2, "Symptom": 2}
    assert labels.review_dataset(df.limit(0)).count() == 0


def test_token_labels_and_back(spark):
    chars = ["B-Drug", "I-Drug", "O", "B-Drug", "B-Symptom", "I-Symptom"]
    offsets = [(0, 0), (0, 1), (1, 2), (2, 3), (3, 4), (4, 6), (6, 6)]
    df = spark.createDataFrame([(chars, offsets), ([], [(0, 0)])], "c array<string>, o array<struct<start:int,end:int>>")
    rows = df.select(labels.token_labels(F.col("c"), F.col("o")).alias("t"), "o", F.size("c").alias("n"))
    got = rows.select("t", labels.char_labels(F.col("t"), F.col("o"), F.col("n")).alias("back")).collect()
    assert got[0].t == [None, "B-Drug", "I-Drug", "O", "B-Drug", "B-Symptom", None] and got[1].t == [None]
    assert got[0].back == chars and got[1].back == []


def test_threshold_grid(spark):
    docs = spark.createDataFrame([(["a", "bb"], [("a", 1, 0.9), ("bb", 2, 0.55), ("bb", 2, 0.9), ("c", 1, 0.4)]), ([], [("d", 1, 0.9)])], "gold array<string>, spans array<struct<span:string,size:int,confidence:double>>")
    got = {(r.min_len, r.threshold): (r.tp, r.fp, r.fn, r.kept, r.routed, r.precision) for r in labels.threshold_grid(docs, (1, 2), (0.5, 0.95)).collect()}
    assert got[(1, 0.5)] == (2, 1, 0, 4, 0.5, pytest.approx(2 / 3)) and got[(2, 0.5)] == (1, 0, 1, 2, 0.5, 1.0) and got[(2, 0.95)] == (0, 0, 2, 0, 0.5, 0.0)


def test_sentences_are_marked_by_found_terms(spark):
    df = spark.createDataFrame([(1, 0, "头痛风"), (1, 1, "无"), (2, 0, "")], "doc_id long, pos int, sentence string")
    terms = [("头痛", "Symptom"), ("痛风", "Disease"), ("头痛风", "Disease"), ("", "X")]
    assert [r.labels for r in labels.label_sentences(df, terms).orderBy("doc_id", "pos").collect()] == [["B-Disease", "I-Disease", "I-Disease"], ["O"], []]
    assert [r.labels for r in labels.label_sentences(df, []).orderBy("doc_id", "pos").collect()] == [["O"] * 3, ["O"], []]

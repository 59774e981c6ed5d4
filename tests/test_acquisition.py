"""Acquisition, publication and the span layer against plain versions on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import acquire, collect, extract, publication, rules
from quillgraph.sources import text_files


def test_first_by_any_key(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, *"abcdefgh"]), rnd.choice([None, *range(12)]), "x") for i in range(120)]
    seen, want = set(), []
    for i, a, b, _ in rows:
        keys = {k for k in (("a", a), ("b", b)) if k[1] is not None}
        if not keys & seen:
            want.append(i)
            seen |= keys
    df = spark.createDataFrame(rows, "at int, a string, b int, key string")
    assert sorted(r.at for r in acquire.first_by_any_key(df, "at", ["a", "b"]).collect()) == want
    assert acquire.first_by_any_key(df.limit(0), "at", ["a", "b"]).count() == 0


def test_sample(spark):
    rows = [(i, "ab"[i % 2], f"t{i}", f"{'长' * 80}{i // 3}" if i != 5 else "短", f"u{i}" if i % 7 else "") for i in range(40)]
    df = spark.createDataFrame(rows, "pos int, category_id string, title string, content string, source_url string")
    got = acquire.sampled(df, "pos", 4, 6).collect()
    assert [r.document_id for r in got] == [f"doc_{i:06d}" for i in range(1, 7)] and len({r.content_hash for r in got}) == 6


def test_manifest(spark):
    cat = spark.createDataFrame([("c1", "R5"), ("c2", "R6")], "category_id string, clc_code string")
    rows = [(1, "b1", "a.txt", "c1", "CLC=R5"), (2, "b1", "x/../b.txt", "c2", "CLC=R6"), (3, "b3", "../b.txt", "c9", "R6"), (4, "", "", None, ""), (5, "b5", "/b.txt", "c1", "CLC=R51"), (6, "b6", "x/../../b", "c1", "R5")]
    df = spark.createDataFrame(rows, "pos int, batch_id string, file string, category_id string, query_text string")
    got = {r.file: ",".join(r.faults) for r in acquire.manifest_faults(df, cat).collect()}
    assert got == {"a.txt": "", "x/../b.txt": "repeated_batch", "../b.txt": "unknown_category,outside_inbox", "": "empty_field,unknown_category", "/b.txt": "code_not_declared,outside_inbox", "x/../../b": "outside_inbox"}


def test_tagged_batches(spark):
    text = "RT Journal\nt1 甲 题\nT1  second\n  more\nAB\nlost\nA3 x；y\nM1 z\nER\nRT x\rT1 乙\rN1 no tag"
    files = spark.createDataFrame([("in/f.txt", text), ("in/g.txt", "RT\nT1 丙\nER"), ("in/none.txt", "RT\nT1 丁")], "path string, content string")
    tagged = text_files.tagged_records(files)
    tags = {(r.path, r.record): r.tags for r in tagged.collect()}
    assert tags[("in/f.txt", 1)] == {"T1": ["甲 题", "second more"], "A3": ["x；y"], "M1": ["z"]} and tags[("in/f.txt", 2)] == {"T1": ["乙 N1 no tag"]}
    manifest = spark.createDataFrame([("g.txt", "b2", "c1", 1), ("f.txt", "b1", "c1", 2)], "file string, batch_id string, category_id string, pos int")
    placed = acquire.batch_records(tagged, manifest)
    assert [(r.path, r.record, r.number) for r in placed.orderBy("number").collect()] == [("in/g.txt", 1, 0), ("in/f.txt", 1, 1), ("in/f.txt", 2, 2)]
    assert [r.number for r in acquire.page_of(placed, 1, 5).orderBy("number").collect()] == [1, 2]


def test_scalars(spark):
    df = spark.createDataFrame([("3.5", "<b>a&lt;1</b> &amp;　x"), ("Wed, 21 Oct 2015 07:28:10 GMT", None), ("soon", ""), (None, "y")], "v string, s string")
    now = F.to_timestamp(F.lit("2015-10-21 07:28:00"))
    got = df.select(acquire.retry_after(F.col("v"), now).alias("w"), acquire.plain_snippet(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == ["a<1 & x", "", "", "y"] and [r.w for r in got][0] == 3.5 and [r.w for r in got][1] == 10
    one = spark.createDataFrame([([0.5, 1.0, 0.25], 1, 3), ([0.5], 1, 1)], "p array<double>, a int, b int")
    assert [r.c for r in one.select(extract.span_confidence(F.col("p"), F.col("a"), F.col("b")).alias("c")).collect()] == [0.625, None]
    s = spark.createDataFrame([(["甲"], "乙。丙"), ([], "乙。丙"), (None, None)], "s array<string>, c string")
    assert [r.x for r in s.select(extract.sentences_of(F.col("s"), F.col("c")).alias("x")).collect()] == [["甲"], ["乙。", "丙"], []]


def test_append_only_prefix(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "pos int, fingerprint string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "pos int, fingerprint string")
    assert [r.pos for r in acquire.prefix_changed(old, new).collect()] == [2] and acquire.prefix_changed(old, old).count() == 0


def test_publication(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "t", '["c"]'), ("d2", None, "[]")], "document_id string, title string, category_ids string")
    audit = spark.createDataFrame([(True,)], "passed boolean")
    base = publication.publish(docs, docs.limit(0), audit, str(tmp_path), "r1")
    assert publication.contract_faults(spark, base) == []
    assert publication.digest(docs).first() == publication.digest(docs.orderBy(F.desc("document_id"))).first() != publication.digest(docs.limit(1)).first()
    with pytest.raises(FileExistsError):
        publication.publish(docs, docs, audit, str(tmp_path), "r1")
    target = spark.createDataFrame([("d1", "old", "keep", 5)], "document_id string, title string, category_ids string, n int")
    got = {r.document_id: (r.title, r.category_ids, r.n) for r in publication.import_generation(target, base).collect()}
    assert got == {"d1": ("t", "keep", 5), "d2": (None, "[]", None)}
    bad = publication.publish(docs.union(docs).withColumn("run_id", F.lit("other")), docs.limit(0), audit.limit(0), str(tmp_path), "r2")
    assert publication.contract_faults(spark, bad) == ["repeated_ids", "other_runs", "audit"]
    docs.limit(1).write.mode("append").json(f"{base}/documents")
    assert {"documents_records", "documents_digest"} <= set(publication.contract_faults(spark, base))
    with pytest.raises(ValueError):
        publication.import_generation(target, base)


def test_insert_and_clear(spark):
    t = spark.createDataFrame([(7, "a", "r", "b", "X"), (8, "a", "r", "b", None)], "id long, subject string, relation string, object string, object_type string")
    e = spark.createDataFrame([(7, "d", "x"), (7, None, "x")], "triple_id long, source_document_id string, source_text string")
    batch = [(1, "a", "r", "b", "X", "d", "x"), (2, "a", "r", "b", "X", None, "x"), (3, "c", "r", "b", "X", "d", "y"), (4, "c", "r", "b", "X", "d", "y"), (5, "a", "r", "b", None, "d", "z"), (6, "", "r", "b", "X", "d", "z")]
    b = spark.createDataFrame(batch, "pos long, subject string, relation string, object string, object_type string, source_document_id string, source_text string")
    facts, proof = publication.insert_facts(t, e, b)
    assert sorted((r.id, r.subject) for r in facts.collect()) == [(7, "a"), (8, "a"), (9, "c"), (10, "a")]
    assert sorted(map(str, proof.collect())) == sorted(map(str, [*e.collect(), *spark.createDataFrame([(7, None, "x"), (9, "d", "y"), (10, "d", "z")], e.schema).collect()]))
    assert [x.count() for x in publication.cleared(t, e)] == [0, 0]


def test_span_layer(spark):
    docs = spark.createDataFrame([(1, "甲病"), (2, "某药"), (3, None)], "doc_id long, title string")
    spans = [
        (1, 0, "甲病头痛，abc", "头痛", "Symptom", 0.9, 2, 4), (1, 0, "甲病头痛，abc", "abc", "Drug", 0.9, 5, 8), (1, 1, "患者头晕等", "头晕等", "Symptom", 0.8, 2, 5), (1, 2, "死亡", "死亡", "Symptom", 0.9, 0, 2),
        (2, 0, "发热", "发热", "Symptom", 0.9, 0, 2), (2, 1, "热", "热", "Symptom", 0.9, 0, 1), (2, 2, "乙病发热", "乙病", "Disease", 0.9, 0, 2), (2, 2, "乙病发热", "发热", "Symptom", 0.5, 2, 4), (3, 0, "发热", "发热", "Symptom", 0.9, 0, 2), (2, 3, "发热", "发热", "Symptom", 0.9, 0, 2),
    ]
    s = spark.createDataFrame(spans, "doc_id long, pos int, sentence string, term string, type string, confidence double, start int, end int")
    facts, routed = extract.span_layer(s, docs)
    assert sorted((r.doc_id, r.pos, r.subject, r.object, r.confidence) for r in facts.collect()) == [(1, 0, "甲病", "头痛", 0.72), (1, 1, "甲病", "头晕", 0.64)]
    assert sorted((r.doc_id, r.sentence, r.pos) for r in routed.collect()) == [(2, "乙病发热", 2), (2, "发热", 0), (2, "热", 1)]


def test_sentences_are_tagged_once(spark, tmp_path):
    seen = tmp_path / "seen"

    def tagger(sentences):
        with seen.open("a") as f:
            f.writelines(f"{x}\n" for x in sentences)
        return sentences.map(lambda x: [{"term": "头痛", "type": "Symptom", "confidence": 0.9, "start": 0, "end": 2}] if "头痛" in x else [])

    docs = spark.createDataFrame([(1, "甲病", "头痛。发热。"), (2, "某药", "头痛！")], "doc_id long, title string, content string")
    facts, routed = extract.span_layer(extract.tag_spans(extract.sentence_rows(docs), tagger), docs)
    assert [(r.doc_id, r.subject) for r in facts.collect()] == [(1, "甲病")] and [r.doc_id for r in routed.collect()] == [2]
    assert sorted(seen.read_text().split()) == ["发热。", "头痛。", "头痛！"]


def test_triggers(spark):
    docs = [(1, "d1", "甲病", "症状有头痛和咳嗽头痛。治疗用药片；出现甲病。", '["c"]'), (2, "d2", "甲病", "表现为头痛。", "c"), (3, "d3", "乙病", "症状有头痛", "[]"), (4, None, "丙", "症状有头痛", "c")]
    df = spark.createDataFrame(docs, "doc_id long, document_id string, title string, content string, category_ids string")
    terms = [("头痛", "Symptom"), ("咳嗽头痛", "Symptom"), ("药片", "Drug"), ("甲病", "Symptom")]
    got = sorted((r.document_id, r.relation, r.object, r.object_type) for r in extract.trigger_facts(df, terms).collect())
    assert got == [("d1", "常见症状", "咳嗽头痛", "症状"), ("d1", "常见症状", "头痛", "症状"), ("d1", "治疗", "药片", "药物")]


def test_asked(spark):
    def ask(prompt, fault):
        return {"good": "x [1] y", "never": "no"}.get(prompt, '["second"]' if fault else "[broken")

    df = spark.createDataFrame([(1, "good"), (2, "retry"), (3, "never")], "doc_id long, prompt string")
    assert [(r.answer, r.calls) for r in extract.asked(df, ask).orderBy("doc_id").collect()] == [("[1]", 1), ('["second"]', 2), ("[]", 3)]


CATALOG = [("c1", "R5", "甲", None, "x", 5, "true", "a", "yes"), ("c2", "[r6]", "乙", None, "y", 5, "0", "a", "no")]


def test_catalog_is_checked(spark):
    df = lambda rows: spark.createDataFrame(rows, text_files.CATALOG)
    assert [r.category_id for r in collect.checked_catalog(df(CATALOG)).collect()] == ["c1"]
    assert collect.checked_catalog(df(CATALOG), False).count() == 2
    for rows in (CATALOG + [CATALOG[0]], [("c3", "Q1", *CATALOG[0][2:])], [CATALOG[1]], [("c4", "R9", "x", None, "t", 5, "maybe", "a", "yes")]):
        with pytest.raises(ValueError):
            collect.checked_catalog(df(rows))
    every = collect.checked_catalog(df(CATALOG), False)
    assert [r.category_id for r in collect.select_categories(every, ["r6", "c1", "R6"]).collect()] == ["c2", "c1"]
    assert collect.select_categories(every, [" "]).count() == 2
    with pytest.raises(ValueError):
        collect.select_categories(every, ["c1", "c9"])


def test_review_list(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": 1, "subject": "a", "relation": "r", "object": "b", "review": "reject"}, {"id": 1, "subject": "a", "relation": "r", "object": "b", "review": "reject"}, {"id": 2, "subject": "a", "relation": "r", "object": "b", "review": "keep"}, {"id": 3, "subject": "", "relation": "r", "object": "b", "review": "reject"}]', encoding="utf-8")
    rejects = text_files.read_review_list(spark, str(tmp_path / "r.json"))
    assert [(r.id, r.source_document_id) for r in rejects.collect()] == [(1, None)]
    facts = spark.createDataFrame([(1, "a", "T", "r", "b", "T", None, None, 0.9), (2, "a", "T", "r", "b", "T", None, None, 0.9)], "id long, subject string, subject_type string, relation string, object string, object_type string, source_document_id string, source_text string, confidence double")
    titles = spark.createDataFrame([], "document_id string, title string")
    flagged = rules.broken_rules(facts, titles, rejects)
    assert {r.id: list(r.broken) for r in flagged.collect()} == {1: ["review"], 2: []}

"""Edge cases of text functions, merges, stored tables, sources and streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillgraph import ontology
from quillgraph.functions import ids, text
from quillgraph.operators import dedupe, extract, labels, rules, store
from quillgraph.sources import text_files
from quillgraph.sources.paged import paged_source
from quillgraph.streaming import identity, incremental


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.clean_text(F.col("a")), a="Ａ&nbsp;<b>x</b>　y\u0007 ") == "A x y"
    assert one(spark, text.sentences(F.col("a")), a="甲。乙！ 丙;丁. 戊") == ["甲。", "乙！", "丙;", "丁. 戊"]
    assert one(spark, text.plain_sentences(F.col("a")), a="甲。乙\n丙") == ["甲", "乙", "丙"]
    assert one(spark, text.tokens(F.col("a")), a="肺炎CT-2.0x！ b") == ["肺炎", "CT-2.0x", "！", "b"]
    assert one(spark, text.strip_filler(F.col("a")), a="咳嗽等等") == "咳嗽"
    assert one(spark, text.trim_boundary(F.col("a")), a="的流感疫苗，") == "流感疫苗"
    assert [(c.start, c.text) for c in one(spark, text.clauses(F.col("a")), a="甲，乙 丙。丁")] == [(0, "甲"), (2, "乙 丙"), (6, "丁")]
    assert one(spark, text.bigrams(F.col("a")), a="甲乙甲乙") == ["甲乙", "乙甲"] and one(spark, text.bigrams(F.col("a")), a="") == []
    assert one(spark, text.supported(F.col("a"), F.col("b")), a="甲，乙", b="甲乙丙") is True
    assert one(spark, text.supported(F.col("a"), F.col("b")), a="……", b="甲") is False


def test_ids(spark):
    url = "HTTPS://M.Example.org/a/b/?utm_source=x&b=2&a=1&ref=z#frag"
    assert one(spark, ids.canonical_url(F.col("a")), a=url) == "https://m.example.org/a/b?a=1&b=2"
    assert one(spark, ids.canonical_url(F.col("a")), a="http://X") == "http://x/"
    assert one(spark, ids.canonical_url(F.col("a")), a="ftp://X/Y") == "ftp://X/Y" and one(spark, ids.canonical_url(F.col("a")), a=None) == ""
    assert one(spark, ids.plain_doi(F.col("a")), a="https://doi.org/10.1/X") == "10.1/x"
    assert one(spark, ids.declares_code(F.col("a"), F.col("b")), a="CLC=R56", b="R56") is True
    assert one(spark, ids.declares_code(F.col("a"), F.col("b")), a="CLC=R56.3", b="R56") is False
    assert one(spark, ids.class_code(F.col("a")), a="[r155]") == "R155"


def test_ontology(spark):
    assert one(spark, ontology.resolve_type(F.col("a")), a=" disease ") == "Disease"
    assert one(spark, ontology.resolve_type(F.col("a")), a="症状") == "Symptom"
    assert one(spark, ontology.resolve_type(F.col("a")), a="x") is None
    assert one(spark, ontology.fits(F.col("r"), F.col("s"), F.col("o")), r="TREATED_BY", s=None, o="Drug") is True
    assert one(spark, ontology.fits(F.col("r"), F.col("s"), F.col("o")), r="TREATED_BY", s="Drug", o="Drug") is False


FACT = "id long, subject string, relation string, object string, object_type string, confidence double, layer string"


def python_merge(rows):
    spec = {r: v[3] for r, v in ontology.RELATIONS.items()}
    merged = {}
    for t in rows:
        old = merged.get(t[1:5])
        if old is None or t[5] > old[5] or (t[5] == old[5] and t[6] == "rule"):
            merged[t[1:5]] = t
    pairs = {}
    for t in merged.values():
        pairs.setdefault((t[1], t[3]), []).append(t)
    return {max(g, key=lambda t: (spec.get(t[2], 0), t[5], t[6] != "deep_learning"))[0] for g in pairs.values()}


def test_layer_merge(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.choice(list(ontology.RELATIONS)), rnd.choice("xyz"), rnd.choice("DS"), rnd.choice([0.5, 0.7, 0.9]), rnd.choice(["rule", "llm", "deep_learning"])) for i in range(400)]
    got = {r.id for r in dedupe.merge_layers(spark.createDataFrame(rows, FACT)).collect()}
    assert got == python_merge(rows)


def test_keep_best(spark):
    df = spark.createDataFrame([(1, " a", "r", "b", None, None, None), (2, "a ", "r", "b", None, 0.0, None), (3, "a", "r", "b", None, 0.4, None), (4, None, "r", "b", None, 0.1, None), (5, "", "r", "b", None, 0.1, None)], FACT)
    assert {r.id for r in dedupe.keep_best(df).where("action = 'keep'").collect()} == {3, 4}


def test_stored_tables(spark):
    t = spark.createDataFrame([("1", "old", "c1"), ("2", "old", "c2")], "document_id string, title string, category string")
    s = spark.createDataFrame([("2", "new", "n2"), ("3", "new", "n3")], "document_id string, title string, category string")
    assert sorted(map(tuple, store.upsert(t, s, "document_id", ["title"]).collect())) == [("1", "old", "c1"), ("2", "new", "c2"), ("3", "new", "n3")]
    facts = spark.createDataFrame([(1, "a", "r", "b", None, 0.1, "x"), (2, "a", "r", "b", None, 0.1, "x"), (3, "a", "r", "b", "T", 0.1, "x"), (4, "a", "r", "b", "T", 0.1, "x")], FACT)
    assert {r.id for r in store.insert_or_ignore(facts.limit(0), facts).collect()} == {1, 2, 3}


def test_whole_tables_are_merged(spark, sf_dir):
    from quillgraph.plans import document_queries, fact_queries
    from quillgraph.runtime import table

    docs = {r.document_id for r in table(spark, sf_dir, "documents").collect() if r.document_id}
    recs = {r.document_id for r in table(spark, sf_dir, "records").collect() if r.document_id}
    assert docs & recs and recs - docs
    for name in ("import_records", "import_missing_records", "merge_records"):
        got = [r.document_id for r in document_queries.Q[name](spark, sf_dir).select("document_id").collect()]
        assert len(got) == len(set(got)) and set(got) == docs | recs
    low = {r.id for r in table(spark, sf_dir, "triples").where("confidence < 0.4").collect()}
    assert low and {r.id for r in fact_queries.Q["review_semi"](spark, sf_dir).collect()} == low


def test_unknown_rule():
    with pytest.raises(ValueError):
        rules.broken_rules(None, rules=("nonsense",))


def test_answers(spark):
    content = "甲病可见头痛。"
    good = '{"subject":"甲病","subject_type":"疾病","relation":"HAS_SYMPTOM","object":"头痛","object_type":"Symptom","evidence":"甲病可见头痛"}'
    bad = good.replace("Symptom", "Drug")
    df = spark.createDataFrame([(1, f"好的：[{good},{bad}] 完", content), (2, "no list", content), (3, None, content)], "k long, answer string, content string")
    out = extract.answer_facts(df, "answer", "content", "k").collect()
    assert [(r.k, r.subject, r.relation, r.object_type) for r in out] == [(1, "甲病", "HAS_SYMPTOM", "Symptom")]


def test_spans(spark):
    df = spark.createDataFrame([(["B-D", "I-D", "O", "I-D", "B-S", "B-S", "I-D"],), ([],)], "l array<string>")
    got = df.select(labels.spans_of(F.col("l")).alias("x")).collect()
    assert [tuple(s) for s in got[0].x] == [(0, 2, "D"), (4, 5, "S"), (5, 6, "S")] and got[1].x == []
    assert labels.mark_terms("肺结核病人", [("结核", "S"), ("肺结核病", "D")]) == ["B-D", "I-D", "I-D", "I-D", "O"]


def test_pairing(spark):
    rows = [(1, 0, "甲病见头痛，乙病见发热", t, k, 0.9, s) for t, k, s in (("甲病", "Disease", 0), ("头痛", "Symptom", 3), ("乙病", "Disease", 6), ("发热", "Symptom", 9))]
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, term string, type string, confidence double, start int")
    assert sorted((r.subject, r.object) for r in extract.pair_spans(df).collect()) == [("乙病", "发热"), ("甲病", "头痛")]


SPAN = "doc_id long, pos int, sentence string, term string, type string, confidence double, start int"


def test_pairing_falls_back_to_titles(spark):
    rows = [(1, 0, "可见头痛", "头痛", "Symptom", 0.9, 2), (2, 0, "可见头痛", "头痛", "Symptom", 0.9, 2), (3, 0, "乙病，见发热", "乙病", "Disease", 0.9, 0), (3, 0, "乙病，见发热", "发热", "Symptom", 0.5, 4)]
    rows += [(4, 0, "感染病", "感染病", "Disease", 0.9, 0), (4, 0, "感染病", "感染病", "RiskFactor", 0.9, 0), (1, 1, "甲病", "甲病", "RiskFactor", 0.9, 0)]
    titles = spark.createDataFrame([(1, " 甲病 "), (2, "综述"), (3, "甲病"), (4, "甲病")], "doc_id long, title string")
    got = extract.pair_spans(spark.createDataFrame(rows, SPAN), titles=titles).collect()
    assert sorted((r.doc_id, r.subject, r.relation, r.object, r.confidence) for r in got) == [(1, "甲病", "HAS_SYMPTOM", "头痛", 0.72), (3, "乙病", "HAS_SYMPTOM", "发热", 0.45)]


def test_pairing_of_whole_documents(spark, sf_dir):
    import re

    from quillgraph.plans import document_queries
    from quillgraph.runtime import table

    docs = table(spark, sf_dir, "documents")
    titles = {r.doc_id: (r.title or "").strip() for r in docs.collect()}
    sentences = {}
    for r in extract.tag_spans(extract.sentence_rows(docs), extract.lexicon_tagger()).collect():
        sentences.setdefault((r.doc_id, r.pos, r.sentence), []).append(r)
    want, by_title = [], 0
    for (doc, pos, sentence), spans in sentences.items():
        clause = lambda x: len(re.findall(r"[，。；：、！？!?;,.]", sentence[: x.start]))  # noqa: B023, E731
        diseases = [(x.term, x.confidence, clause(x)) for x in spans if x.type == "Disease"]
        title = [(titles[doc], 0.8, -1)] if 2 <= len(titles[doc]) <= 20 and titles[doc].endswith(tuple(text.DISEASE_ENDS)) else []
        for x in spans:
            if x.type in extract.RELATION_OF:
                pool = [y for y in diseases if y[2] == clause(x)] or diseases or title
                by_title += not diseases and bool(title)
                want += [(doc, pos, s, extract.RELATION_OF[x.type], x.term) for s, _, _ in pool if s != x.term]
    got = [(r.doc_id, r.pos, r.subject, r.relation, r.object) for r in document_queries.Q["span_facts"](spark, sf_dir).collect()]
    assert by_title and sorted(got) == sorted(want)


def test_tagged_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("RT Journal Article\nA1 甲;乙\nT1 标题\nAB 摘要\n 续行\nYR 2020年\nDO https://doi.org/10.1/X\nCL R563\nER\nRT x\nT1 二\nAB\n丢弃\nER\n", encoding="gb18030")
    files = text_files.read_any_encoding(spark, str(tmp_path / "*.txt"))
    assert files.first().encoding == "gb18030"
    r = {x.record: x for x in text_files.source_records(text_files.tagged_records(files)).collect()}
    assert (r[1].title, r[1].abstract, r[1].authors, r[1].publication_year, r[1].doi, r[1].codes) == ("标题", "摘要 续行", ["甲", "乙"], 2020, "10.1/x", ["R563"])
    assert (r[2].title, r[2].abstract) == ("二", "")


def test_catalog_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("﻿category_id,clc_code,clc_name,parent_code,query_terms,target_count,enabled,authority_source,reviewed\nc1,[r1],名,R,a|b,3,true,x,true\n", encoding="utf-8")
    assert text_files.read_catalog(spark, str(p)).first().category_id in ("c1",)


def test_id_range(spark):
    docs = spark.createDataFrame([("doc_000001",), ("doc_000003",), ("doc_ab",)], "document_id string")
    found, missing = text_files.id_range(docs, 1, 3)
    assert found.count() == 2 and [r.number for r in missing.collect()] == [2]


def test_paged_source(spark, tmp_path):
    def fetch(start, limit):
        return [(i, f"r{i}") for i in range(start, min(start + limit, 95))]

    spark.dataSource.register(paged_source("pages_of_test", "n long, name string", fetch, 40))
    assert spark.read.format("pages_of_test").option("total", 95).load().count() == 95


def test_identity_batch_and_stream(spark, tmp_path):
    rows = [(1, "s", "d1", "h1", ["a", "b"]), (2, "s", "d2", "h1", ["b", "c"]), (3, "s", "d3", "h9", ["c"]), (4, "s", "d4", "h4", ["e"]), (5, "s", "d5", "h1", ["a", "e"]), (6, "t", "d6", "h1", ["a"])]
    schema = "n long, source_name string, document_id string, content_hash string, keys array<string>"
    batch = {r.document_id: r.disposition for r in identity.resolve_batch(spark.createDataFrame(rows, schema), "n").collect()}
    assert batch == {"d1": "accepted", "d2": "duplicate", "d3": "conflict", "d4": "accepted", "d5": "conflict", "d6": "accepted"}
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.json(src)
    q = identity.resolve_stream(spark.readStream.schema(schema).json(src)).writeStream.format("memory").queryName("ident").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r.document_id: r.disposition for r in spark.table("ident").collect()} == batch


def test_changed_stream_equals_batch(spark, tmp_path):
    schema = "document_id string, content_hash string"
    src, seen = str(tmp_path / "docs"), []
    for i, rows in enumerate([[("1", "a"), ("2", "b")], [("1", "a"), ("2", "c"), ("3", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        q = incremental.changed_stream(spark.readStream.schema(schema).json(src), str(tmp_path / "state"), lambda df, n: seen.append(sorted(map(tuple, df.collect()), key=str)), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert seen == [[("1", "a"), ("2", "b")], [("2", "c"), ("3", None)]]
    assert sorted(map(tuple, incremental.read_state(spark, str(tmp_path / "state")).collect())) == [("1", "a"), ("2", "c")]


def test_publish_refuses_overwriting(spark, tmp_path):
    df = spark.range(3)
    path = store.publish(df, str(tmp_path), "run_1")
    assert os.path.isdir(path)
    with pytest.raises(Exception):
        store.publish(df, str(tmp_path), "run_1")

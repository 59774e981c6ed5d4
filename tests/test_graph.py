"""Graph views on small fixtures with exact counts."""

import json

import pytest

from quillgraph.operators import graph
from quillgraph.ontology import UNTYPED

SCHEMA = "id long, subject string, subject_type string, relation string, object string, object_type string, source_document_id string, source_text string, confidence double"


def triple(i, **kw):
    t = dict(id=i, subject="甲", subject_type="疾病", relation="表现", object="乙", object_type="症状", source_document_id="doc1", source_text="原句", confidence=None)
    return tuple((t | kw).values())


def frame(spark, *rows):
    return spark.createDataFrame([triple(i, **kw) for i, kw in enumerate(rows)], SCHEMA)


def node(name, kind):
    return json.dumps([name, kind], ensure_ascii=False, separators=(",", ":"))


def test_merge(spark):
    df = frame(spark, {}, {}, {"source_document_id": "doc2"})
    g = graph.build(df)
    assert g.nodes.count() == 2
    e = g.edges.collect()
    assert len(e) == 1 and e[0].n_evidence == 2 and e[0].confidence == 0.72 and e[0].source == node("甲", "疾病")
    s = graph.statistics(df).first()
    assert (s.record_count, s.document_count, s.skipped) == (3, 2, 0)


def test_same_name_of_another_type(spark):
    assert graph.build(frame(spark, {}, {"object": "甲"})).nodes.count() == 3


def test_invalid_rows_and_missing_fields(spark):
    df = frame(spark, {"subject": None}, {"relation": "  "}, {"subject_type": None, "object_type": "", "source_document_id": None, "source_text": None})
    assert graph.statistics(df).first().skipped == 2
    g = graph.build(df)
    assert {r.type for r in g.nodes.collect()} == {UNTYPED} and g.edges.first().n_evidence == 0


def test_markup_is_kept(spark):
    df = frame(spark, {"object": "<script>alert(1)</script>"})
    assert any(r.name == "<script>alert(1)</script>" for r in graph.build(df).nodes.collect())


def test_filter_and_search(spark):
    g = graph.build(frame(spark, {}, {"object": "丙", "object_type": "药物", "relation": "治疗"}))
    f = graph.filtered(g, ["疾病", "症状"], ["表现", "治疗"])
    assert f.edges.count() == 1 and graph.search(f, "丙").count() == 0
    assert graph.filtered(g, [], []).nodes.count() == 0
    assert graph.filtered(g, ["药物"], ["表现"], keep_isolated=True).nodes.count() == 1
    assert graph.search(g, "  甲  ").count() == 1 and graph.search(g, "").count() == 3


def test_neighbourhood(spark):
    g = graph.build(frame(spark, {}, {"object": "丙", "object_type": "药物", "relation": "治疗"}))
    n = graph.neighbourhood(g)
    assert n.nodes.count() == 3 and n.nodes.orderBy("degree", ascending=False).first().name == "甲"


def test_star_of_100(spark):
    g = graph.build(frame(spark, *({"object": f"节点{i}"} for i in range(100))))
    n = graph.neighbourhood(g)
    assert n.nodes.count() == 80 and n.edges.count() == 79
    assert [r.id for r in graph.neighbourhood(g).nodes.orderBy("id").collect()] == [r.id for r in n.nodes.orderBy("id").collect()]


def test_overview_is_the_greedy_choice(spark):
    rows = [{"object": f"概览{i}"} for i in range(160)] + [{"subject": f"旁{i}", "object": f"旁{i + 1}"} for i in range(40)] + [{"subject": "环", "object": "环", "object_type": "疾病"}]
    g = graph.build(frame(spark, *rows))
    degree = {r.id: r.degree for r in graph.degrees(g).collect()}
    ranked = sorted(g.edges.collect(), key=lambda e: (-(degree[e.source] + degree[e.target]), -e.confidence, e.id))
    for most_nodes, most_edges in ((80, 100), (165, 170), (3, 50), (500, 500)):
        seen, want = set(), []
        for e in ranked:
            if len(want) >= most_edges:
                break
            if len(seen) + (e.source not in seen) + (e.target not in seen) > most_nodes:
                continue
            seen |= {e.source, e.target}
            want.append(e.id)
        assert [r.id for r in graph.representative(g, most_nodes, most_edges).orderBy("rank").collect()] == want


def test_confidence(spark):
    g = graph.build(frame(spark, {"confidence": 0.81}, {"object": "丙", "confidence": 0.59}))
    assert graph.confident(g, 0.8).edges.count() == 1 and graph.confident(g, 0.55).edges.count() == 2


def test_bipartite(spark):
    d = {"subject_type": "Disease"}
    g = graph.build(frame(spark, d | {"relation": "HAS_SYMPTOM", "object_type": "Symptom"}, d | {"relation": "TREATED_BY", "object": "药", "object_type": "Drug"}))
    b = graph.bipartite(g)
    assert b.nodes.count() == 2 and [e.relation for e in b.edges.collect()] == ["HAS_SYMPTOM"]


def test_similarity(spark):
    rows = [{"subject": s, "subject_type": "Disease", "relation": "HAS_SYMPTOM", "object": o, "object_type": "Symptom"} for s in ("疾病甲", "疾病乙") for o in ("头痛", "发热")]
    e = graph.similarity(graph.build(frame(spark, *rows))).collect()
    assert len(e) == 1 and e[0].shared == 2


def test_loop_counts_once(spark):
    g = graph.build(frame(spark, {"object": "甲", "object_type": "疾病"}))
    assert [r.degree for r in graph.degrees(g).collect()] == [1]


@pytest.mark.parametrize("view", [graph.bipartite, graph.neighbourhood])
def test_empty(spark, view):
    g = graph.build(spark.createDataFrame([], SCHEMA))
    assert view(g).nodes.count() == 0 and graph.similarity(g).count() == 0 and graph.representative(g, 10, 10).count() == 0


def test_evidence_and_flags_in_order(spark):
    df = frame(spark, {}, {"source_document_id": "doc2"}, {}, {"source_text": ""}, {"source_document_id": None, "source_text": " "})
    flagged = df.selectExpr("*", "case id when 0 then array('b') when 1 then array('a', 'b') when 2 then null else array('c') end AS quality_flags")
    g = graph.build(flagged)
    assert [(r.position, r.source_document_id, r.source_text) for r in graph.evidence(g).orderBy("position").collect()] == [(1, "doc1", "原句"), (2, "doc2", "原句"), (3, "doc1", "")]
    assert [r.flags for r in graph.edge_flags(g).collect()] == [["b", "a", "c"]]
    assert graph.edge_flags(graph.build(df)).count() == 0


def test_totals_before_the_cut(spark):
    g = graph.build(frame(spark, *({"object": f"乙{i}"} for i in range(100))))
    near = graph.neighbourhood(g)
    assert near.nodes.count() == 80 and near.totals.first().total_nodes == 101
    rows = [{"subject": s, "subject_type": "Disease", "relation": "HAS_SYMPTOM", "object": f"状{i}", "object_type": "Symptom"} for i in range(8) for s in ("甲病", "乙病")]
    g = graph.build(frame(spark, *rows))
    cut = graph.bipartite(g, 1, 3, 2)
    assert cut.edges.count() == 2 and tuple(cut.totals.first()) == (10, 16) and tuple(graph.full(g).totals.first()) == (10, 16)
    view = graph.similarity_view(g)
    e = view.edges.first()
    assert (e.relation, e.weight, list(e.shared_names)) == ("SHARES_SYMPTOM", 8, [f"状{i}" for i in range(8)]) and tuple(view.totals.first()) == (2, 1) and view.nodes.count() == 2


def test_common_symptom_brings_no_pairs(spark):
    """A symptom that all have is no reason to meet; pairs are found by what else they share."""
    rows = [{"subject": f"病{i}", "subject_type": "Disease", "relation": "HAS_SYMPTOM", "object": o, "object_type": "Symptom"} for i in range(60) for o in ("共", f"独{i // 2}", f"又{i}")]
    pairs = graph.similar_pairs(graph.build(frame(spark, *rows))).collect()
    assert len(pairs) == 30 and {r.shared for r in pairs} == {2}


def test_panels(spark):
    g = graph.build(frame(spark, {"confidence": 0.55}, {"object": "丙", "confidence": 0.9, "source_document_id": None, "source_text": None}))
    d = {(r.panel, r.label): r.n for r in graph.dashboard(g).collect()}
    assert d[("evidence_percent", "")] == 50 and d[("low_quality", "")] == 1
    p = {(r.panel, r.label): r.n for r in graph.filter_panel(g).collect()}
    assert p[("slider", "0.50")] == 2 and p[("slider", "0.81")] == 1 and p[("type", "症状")] == 2
    assert [(r.nodes, r.edges) for r in graph.packed(g).collect()] == [(3, 2)]

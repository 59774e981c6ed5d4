"""Queries over the graph of facts, and their SQL. Names are ordered by code point in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..runtime import table
from . import sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _g(spark, d):
    return graph.build(table(spark, d, "triples"))


E = sql.EDGES


@query(f"WITH {E} SELECT id, source, target, relation, confidence, n_evidence FROM edges")
def edge_merge(spark, d):
    return _g(spark, d).edges.select("id", "source", "target", "relation", "confidence", "n_evidence")


@query(f"WITH {E} SELECT id, name, type FROM nodes")
def graph_nodes(spark, d):
    return _g(spark, d).nodes


@query(f"SELECT count(*) AS record_count, count(*) FILTER (WHERE NOT ({sql.VALID})) AS skipped, count(DISTINCT CASE WHEN {sql.VALID} AND {sql.s('source_document_id')} <> '' THEN {sql.s('source_document_id')} END) AS document_count FROM triples")
def graph_stats(spark, d):
    return graph.statistics(table(spark, d, "triples"))


@query(f"WITH {E} SELECT id, degree FROM degree")
def degree(spark, d):
    return graph.degrees(_g(spark, d))


@query(f"WITH {E} SELECT id, name FROM nodes WHERE contains(lower(name), 'bk') ORDER BY name, id")
def node_search(spark, d):
    return graph.search(_g(spark, d), " BK ").select("id", "name")


_FE = "fe AS (SELECT e.* FROM edges e JOIN nodes a ON a.id = e.source AND a.type IN ('Disease','Drug') JOIN nodes b ON b.id = e.target AND b.type IN ('Disease','Drug') WHERE e.relation IN ('TREATED_BY','RELATED_TO'))"


@query(f"WITH {E}, {_FE} SELECT id FROM fe")
def graph_filter_edges(spark, d):
    return graph.filtered(_g(spark, d), ["Disease", "Drug"], ["TREATED_BY", "RELATED_TO"]).edges.select("id")


@query(f"WITH {E}, {_FE} SELECT id, name, type FROM nodes WHERE id IN (SELECT source FROM fe UNION SELECT target FROM fe)")
def graph_filter_nodes(spark, d):
    return graph.filtered(_g(spark, d), ["Disease", "Drug"], ["TREATED_BY", "RELATED_TO"]).nodes.select("id", "name", "type")


@query(f"WITH {E} SELECT id, confidence FROM edges WHERE confidence >= 0.7")
def confidence_edges(spark, d):
    return graph.confident(_g(spark, d), 0.7).edges.select("id", "confidence")


@query(f"WITH {E} SELECT id FROM nodes WHERE id IN (SELECT source FROM edges WHERE confidence >= 0.7 UNION SELECT target FROM edges WHERE confidence >= 0.7)")
def confidence_nodes(spark, d):
    return graph.confident(_g(spark, d), 0.7).nodes.select("id")


@query(f"WITH {E} SELECT e.id, a.type AS source_type, b.type AS target_type FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target")
def endpoint_types(spark, d):
    g = _g(spark, d)
    a, b = (g.nodes.select(F.col("id").alias(s), F.col("type").alias(s + "_type")) for s in ("source", "target"))
    return g.edges.join(a, "source").join(b, "target").select("id", "source_type", "target_type")


_S = sql.SYMPTOM_EDGES
_PAIRS = "pairs AS (SELECT a.source AS source, b.source AS target, count(*) AS shared FROM sym a JOIN sym b ON a.target = b.target AND a.source < b.source GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {E}, {_S}, {_PAIRS} SELECT source, target, shared FROM pairs")
def similar_pairs(spark, d):
    return graph.similar_pairs(_g(spark, d))


@query(f"""WITH {E}, {_S}, {_PAIRS}, w AS (SELECT id, sum(shared) AS w FROM (SELECT source AS id, shared FROM pairs UNION ALL SELECT target, shared FROM pairs) GROUP BY id),
  ch AS (SELECT id FROM w ORDER BY w DESC, id LIMIT 120)
  SELECT source, target, shared FROM pairs WHERE source IN (SELECT id FROM ch) AND target IN (SELECT id FROM ch) ORDER BY shared DESC, source, target LIMIT 220""")
def similarity_view(spark, d):
    return graph.similarity(_g(spark, d))


_SIM = f"""{E}, {_S}, {_PAIRS}, w AS (SELECT id, sum(shared) AS w FROM (SELECT source AS id, shared FROM pairs UNION ALL SELECT target, shared FROM pairs) GROUP BY id),
  ch AS (SELECT id FROM w ORDER BY w DESC, id LIMIT 120), top AS (SELECT source, target, shared FROM pairs WHERE source IN (SELECT id FROM ch) AND target IN (SELECT id FROM ch) ORDER BY shared DESC, source, target LIMIT 220)"""


@query(f"""WITH {_SIM} SELECT CAST(to_json(['derived', t.source, t.target]) AS VARCHAR) AS id, 'SHARES_SYMPTOM' AS relation, t.shared AS weight, string_agg(n.name, '|' ORDER BY n.name) AS shared_names
  FROM top t JOIN sym a ON a.source = t.source JOIN sym b ON b.source = t.target AND b.target = a.target JOIN nodes n ON n.id = a.target GROUP BY ALL""")
def similarity_names(spark, d):
    v = graph.similarity_view(_g(spark, d))
    return v.edges.select("id", "relation", "weight", F.array_join("shared_names", "|").alias("shared_names"))


@query(f"WITH {E}, {_S}, {_PAIRS} SELECT (SELECT count(*) FROM (SELECT source FROM pairs UNION SELECT target FROM pairs)) AS total_nodes, (SELECT count(*) FROM pairs) AS total_edges")
def similarity_totals(spark, d):
    return graph.similarity_view(_g(spark, d)).totals


@query(f"WITH {E} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges")
def full_totals(spark, d):
    return graph.full(_g(spark, d)).totals


@query(f"WITH {E}, {_S} SELECT (SELECT count(*) FROM (SELECT source FROM sym UNION SELECT target FROM sym)) AS total_nodes, (SELECT count(*) FROM sym) AS total_edges")
def bipartite_totals(spark, d):
    return graph.bipartite(_g(spark, d)).totals


_CONF = "ce AS (SELECT * FROM edges WHERE confidence >= 0.7)"


@query(f"WITH {E}, {_CONF} SELECT (SELECT count(*) FROM (SELECT source FROM ce UNION SELECT target FROM ce)) AS total_nodes, (SELECT count(*) FROM ce) AS total_edges")
def confidence_totals(spark, d):
    return graph.full(graph.confident(_g(spark, d), 0.7)).totals


@query(f"""WITH {E}, p AS (SELECT source, relation, target, doc AS source_document_id, txt AS source_text, min(id) AS pos FROM v2 WHERE doc <> '' OR txt <> '' GROUP BY ALL)
  SELECT source, relation, target, row_number() OVER (PARTITION BY source, relation, target ORDER BY pos) AS position, source_document_id, source_text FROM p""")
def edge_evidence(spark, d):
    """The different evidence of every edge, in order."""
    return graph.evidence(_g(spark, d))


def _flagged_graph(spark, d):
    t = table(spark, d, "triples").withColumn("quality_flags", F.array_compact(F.array("layer", F.when(F.col("confidence") < 0.5, "low"), F.when(F.col("source_text").isNull(), "no_text"))))
    return graph.build(t)


@query(f"""WITH {E}, x AS (SELECT v2.source, v2.relation, v2.target, v2.id, unnest([1, 2, 3]) AS i, unnest([t.layer, CASE WHEN t.confidence < 0.5 THEN 'low' END, CASE WHEN t.source_text IS NULL THEN 'no_text' END]) AS flag FROM v2 JOIN triples t USING (id)),
  f AS (SELECT source, relation, target, flag, min((id, i)) AS place FROM x WHERE flag IS NOT NULL GROUP BY ALL) SELECT source, relation, target, string_agg(flag, ',' ORDER BY place) AS flags FROM f GROUP BY ALL""")
def edge_flags(spark, d):
    """Union of the quality flags of an edge's facts in the order they are first seen."""
    return graph.edge_flags(_flagged_graph(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query(f"""WITH {E} SELECT 'type' AS panel, type AS label, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation
  UNION ALL SELECT 'slider', printf('%.2f', m / 100), (SELECT count(*) FROM edges WHERE confidence >= m / 100) FROM (SELECT unnest(range(50, 82)) AS m)""")
def filter_panel(spark, d):
    return graph.filter_panel(_g(spark, d))


@query()
def component_sizes(spark, d):
    return graph.packed(_g(spark, d))


@query(f"WITH {E}, f AS (SELECT id FROM degree ORDER BY degree DESC, name, type, id LIMIT 1) SELECT id, degree, round(least(34.0, 10 + 3 * sqrt(degree) + CASE WHEN id = (SELECT id FROM f) THEN 8 ELSE 0 END), 6) AS size FROM degree")
def node_sizes(spark, d):
    g = _g(spark, d)
    return graph.drawn(g, graph.core_entities(g, 1).select(F.col("id").alias("f"))).withColumn("size", F.round("size", 6))


@query(f"WITH {_SIM} SELECT source, target, round(least(7.0, 1.2 + 1.35 * log2(shared)), 6) AS width FROM top")
def edge_widths(spark, d):
    pairs = graph.similarity(_g(spark, d))
    return pairs.select("source", "target", F.round(graph.edge_width(F.col("shared")), 6).alias("width"))


_BI = f"""{E}, {_S}, sd AS (SELECT x AS id, count(*) AS degree FROM (SELECT source AS x FROM sym UNION ALL SELECT target FROM sym WHERE source <> target) GROUP BY x),
  l AS (SELECT n.id FROM nodes n JOIN sd ON sd.id = n.id WHERE n.type = 'Disease' ORDER BY degree DESC, name, type, n.id LIMIT 110),
  r AS (SELECT n.id FROM nodes n JOIN sd ON sd.id = n.id WHERE n.type = 'Symptom' ORDER BY degree DESC, name, type, n.id LIMIT 70),
  be AS (SELECT * FROM sym WHERE source IN (SELECT id FROM l) AND target IN (SELECT id FROM r) ORDER BY first_pos, id LIMIT 800)"""


@query(f"WITH {_BI} SELECT id, source, target FROM be")
def bipartite_view(spark, d):
    return graph.bipartite(_g(spark, d)).edges.select("id", "source", "target")


_NB = f"""{E}, f AS (SELECT id FROM degree ORDER BY degree DESC, name, type, id LIMIT 1),
  nb AS (SELECT DISTINCT CASE WHEN source = f.id THEN target ELSE source END AS id FROM edges, f WHERE source = f.id OR target = f.id),
  vis AS (SELECT id, name, type, degree FROM (SELECT d.*, CASE WHEN d.id = (SELECT id FROM f) THEN 1 ELSE 0 END AS isf FROM degree d WHERE d.id IN (SELECT id FROM nb) OR d.id IN (SELECT id FROM f)) ORDER BY isf DESC, degree DESC, name, type, id LIMIT 80)"""


@query(f"WITH {_NB} SELECT id, name, type, degree FROM vis")
def neighbourhood_nodes(spark, d):
    return graph.neighbourhood(_g(spark, d)).nodes


@query(f"WITH {_NB} SELECT id FROM edges WHERE source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)")
def neighbourhood_edges(spark, d):
    return graph.neighbourhood(_g(spark, d)).edges.select("id")


@query(f"WITH {E} SELECT id, name, type, degree FROM degree ORDER BY degree DESC, name, type, id LIMIT 5")
def core_entities(spark, d):
    return graph.core_entities(_g(spark, d))


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY name, type, id) AS position, id, name, type FROM nodes")
def node_order(spark, d):
    return graph.ordered_nodes(_g(spark, d))


@query(f"""WITH {E} SELECT 'type' AS panel, type AS label, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation
  UNION ALL SELECT 'isolated', '', count(*) FROM degree WHERE degree = 0 UNION ALL SELECT 'low_quality', '', count(*) FROM edges WHERE confidence < 0.6
  UNION ALL SELECT 'with_evidence', '', count(*) FROM edges WHERE n_evidence > 0 UNION ALL SELECT 'evidence_percent', '', floor(100.0 * count(*) FILTER (WHERE n_evidence > 0) / count(*) + 0.5)::BIGINT FROM edges""")
def dashboard(spark, d):
    return graph.dashboard(_g(spark, d))


_TOP1 = "f AS (SELECT id AS f FROM degree ORDER BY degree DESC, name, type, id LIMIT 1)"


@query(f"""WITH {E}, {_TOP1}, near AS (SELECT * FROM edges, f WHERE source = f OR target = f),
  docs AS (SELECT n.relation, count(DISTINCT v2.doc) AS documents FROM near n JOIN v2 ON v2.source = n.source AND v2.relation = n.relation AND v2.target = n.target WHERE v2.doc <> '' GROUP BY 1)
  SELECT n.relation, count(*) AS edges, sum(n_evidence)::BIGINT AS evidence, coalesce(any_value(documents), 0) AS documents FROM near n LEFT JOIN docs ON docs.relation = n.relation GROUP BY n.relation""")
def entity_detail(spark, d):
    g = _g(spark, d)
    return graph.entity_detail(g, graph.core_entities(g, 1).select(F.col("id").alias("f")))


@query(f"WITH {E}, {_TOP1} SELECT (SELECT count(*) FROM (SELECT f AS id FROM f UNION SELECT source FROM edges, f WHERE target = f UNION SELECT target FROM edges, f WHERE source = f)) AS total_nodes")
def neighbourhood_totals(spark, d):
    return graph.neighbourhood(_g(spark, d)).totals.select("total_nodes")


@query()
def overview(spark, d):
    return graph.representative(_g(spark, d), 420, 1200)


@query()
def confidence_overview(spark, d):
    return graph.representative(graph.confident(_g(spark, d), 0.7), 520, 1500)

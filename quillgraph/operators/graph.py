"""Graph views over facts: vertices and edges as two DataFrames.

Views that are bounded by their definition (a page, a top list, an overview of some hundred nodes) rank in Spark and
cut with TakeOrdered; only the overview's greedy choice, whose result is bounded by its budget, needs rows in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology
from ..functions.ids import node_id
from ..functions.text import stripped
from ..runtime import discard, materialize
from .components import connected
from .rules import valid

DEFAULT_CONFIDENCE = 0.72


@dataclass
class Graph:
    nodes: DataFrame  # id, name, type
    edges: DataFrame  # id, source, target, relation, confidence, n_evidence, first_pos
    facts: DataFrame | None = None  # source, relation, target, source_document_id, source_text, flags, pos


@dataclass
class View(Graph):
    """A part of a graph with the totals before it was cut: one row total_nodes, total_edges."""

    totals: DataFrame | None = None


def name_order(*columns: str) -> list:
    """Order of names as a Chinese reader expects it, then by code point."""
    return [F.collate(F.col(c), "zh") for c in columns] + [F.col(c) for c in columns]


def build(triples: DataFrame, pos: str = "id") -> Graph:
    """Vertices by (name, type), edges by (source, relation, target) with the least confidence and distinct evidence."""
    kind = lambda c: F.when(stripped(F.col(c)) == "", ontology.UNTYPED).otherwise(stripped(F.col(c)))
    t = valid(triples).select(
        *(stripped(F.col(c)).alias(c) for c in ("subject", "relation", "object", "source_document_id", "source_text")),
        kind("subject_type").alias("st"),
        kind("object_type").alias("ot"),
        F.coalesce(F.col("confidence"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.col(pos).alias("pos"),
    )
    t = t.withColumn("source", node_id(F.col("subject"), F.col("st"))).withColumn("target", node_id(F.col("object"), F.col("ot")))
    nodes = t.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("subject").alias("name"), F.col("st").alias("type")), F.struct(F.col("target").alias("id"), F.col("object").alias("name"), F.col("ot").alias("type")))).alias("n")).select("n.*").distinct()
    proof = F.when((F.col("source_document_id") != "") | (F.col("source_text") != ""), F.struct("source_document_id", "source_text"))
    edges = t.groupBy("source", "relation", "target").agg(F.least(F.lit(1.0), F.min("confidence")).alias("confidence"), F.count_distinct(proof).alias("n_evidence"), F.min("pos").alias("first_pos"))
    flags = F.col("quality_flags") if "quality_flags" in triples.columns else F.array().cast("array<string>")
    facts = valid(triples).select(
        node_id(stripped(F.col("subject")), kind("subject_type")).alias("source"), stripped(F.col("relation")).alias("relation"), node_id(stripped(F.col("object")), kind("object_type")).alias("target"),
        stripped(F.col("source_document_id")).alias("source_document_id"), stripped(F.col("source_text")).alias("source_text"), flags.alias("flags"), F.col(pos).alias("pos"),
    )
    return Graph(nodes, edges.withColumn("id", F.to_json(F.array("source", "relation", "target"))), facts)


def evidence(g: Graph) -> DataFrame:
    """``source, relation, target, position, source_document_id, source_text``: each edge's different evidence in the
    order of its first fact, one row each, so that an edge of very many facts is no single value."""
    e = g.facts.where("source_document_id <> '' OR source_text <> ''")
    e = e.groupBy("source", "relation", "target", "source_document_id", "source_text").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("source", "relation", "target").orderBy("pos")
    return e.select("source", "relation", "target", F.row_number().over(w).alias("position"), "source_document_id", "source_text")


def edge_flags(g: Graph) -> DataFrame:
    """``source, relation, target, flags``: the union of an edge's quality flags in the order they are first seen.

    Flags are gathered by their first place, so a list is no longer than the number of different flags.
    """
    f = g.facts.select("source", "relation", "target", F.posexplode("flags").alias("i", "flag"), "pos")
    f = f.groupBy("source", "relation", "target", "flag").agg(F.min(F.struct("pos", "i")).alias("at"))
    return f.groupBy("source", "relation", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "flag"))), lambda x: x["flag"]).alias("flags"))


def _totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # one row each
    return nodes.agg(F.count("*").alias("total_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("total_edges"))))


def full(g: Graph) -> View:
    return View(g.nodes, g.edges, g.facts, _totals(g.nodes, g.edges))


def statistics(triples: DataFrame) -> DataFrame:
    """One row: records, skipped (invalid) records, distinct documents of valid records."""
    ok = (stripped(F.col("subject")) != "") & (stripped(F.col("relation")) != "") & (stripped(F.col("object")) != "")
    doc = stripped(F.col("source_document_id"))
    return triples.agg(F.count("*").alias("record_count"), F.count_if(~ok).alias("skipped"), F.count_distinct(F.when(ok & (doc != ""), doc)).alias("document_count"))


def degrees(g: Graph) -> DataFrame:
    """``id, degree`` of every node: a loop counts once, isolated nodes 0."""
    ends = g.edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    return g.nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def filtered(g: Graph, types: list[str], relations: list[str], keep_isolated: bool = False) -> Graph:
    nodes = g.nodes.where(F.col("type").isin(*types)) if types else g.nodes.limit(0)
    edges = g.edges.where(F.col("relation").isin(*relations)) if relations else g.edges.limit(0)
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return Graph(nodes if keep_isolated else _used(nodes, edges), edges)


def _used(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def confident(g: Graph, least: float) -> Graph:
    edges = g.edges.where(F.col("confidence") >= least)
    return Graph(_used(g.nodes, edges), edges)


def search(g: Graph, query: str) -> DataFrame:
    """Nodes whose name holds the query in any case, in the order of their names; an empty query finds all."""
    q = query.strip().lower()
    found = g.nodes.where(F.contains(F.lower("name"), F.lit(q))) if q else g.nodes
    return found.orderBy(*name_order("name"), "id")


def _top(g: Graph, kind: str, degree: DataFrame, most: int) -> DataFrame:
    nodes = g.nodes.where(F.col("type") == kind).join(degree, "id").where("degree > 0")
    return nodes.orderBy(F.desc("degree"), "name", "type", "id").limit(most).select("id", "name", "type", "degree")


def symptom_edges(g: Graph) -> DataFrame:
    kinds = lambda side, kind: g.nodes.where(F.col("type") == kind).select(F.col("id").alias(side), F.col("name").alias(side + "_name"))
    return g.edges.where("relation = 'HAS_SYMPTOM'").join(kinds("source", "Disease"), "source").join(kinds("target", "Symptom"), "target")


def bipartite(g: Graph, diseases: int = 110, symptoms: int = 70, most_edges: int = 800) -> View:
    """The diseases and symptoms of highest degree and the first edges among them in input order; totals of all."""
    e = symptom_edges(g)
    d = degrees(Graph(g.nodes, e))
    left, right = _top(g, "Disease", d, diseases), _top(g, "Symptom", d, symptoms)
    edges = e.join(F.broadcast(left.select(F.col("id").alias("source"))), "source", "left_semi").join(F.broadcast(right.select(F.col("id").alias("target"))), "target", "left_semi")
    edges = edges.orderBy("first_pos", "id").limit(most_edges)
    return View(_used(left.unionByName(right), edges), edges, None, _totals(d.where("degree > 0"), e))


def similar_pairs(g: Graph, least: int = 2) -> DataFrame:
    """Pairs of diseases that share ``least`` symptoms or more: ``source, target, shared``.

    Two diseases that share so many share one that is not among the ``least - 1`` commonest of either, so these don't
    join: a symptom that most diseases have brings forth no pairs by itself. The pairs found are counted exactly.
    """
    e = materialize(symptom_edges(g).select("source", "target").distinct(), "symptom-edges")
    ranked = e.join(e.groupBy("target").agg(F.count("*").alias("n")), "target")
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.desc("target"))
    rare = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") >= least).select("source", "target")
    side = lambda df, name: df.select("target", F.col("source").alias(name))
    found = side(rare, "a").join(side(rare, "b"), "target").where("a < b").select("a", "b").distinct()
    pairs = found.join(side(e, "a"), "a").join(side(e, "b"), ["b", "target"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.where(F.col("shared") >= least).select(F.col("a").alias("source"), F.col("b").alias("target"), "shared")


def similarity_view(g: Graph, diseases: int = 120, most_edges: int = 220) -> View:
    """The similarity view: derived edges with the names of the shared symptoms, and the totals before the cut."""
    pairs = similar_pairs(g)
    chosen = strongest(pairs, diseases, most_edges)
    e = symptom_edges(g).select("source", "target", F.col("target_name").alias("name")).distinct()
    # only the symptoms of the chosen pairs, bounded by ``most_edges``, are gathered
    a = chosen.join(e.select("source", F.col("target").alias("symptom"), "name"), "source")
    b = a.join(e.select(F.col("source").alias("target"), F.col("target").alias("symptom")), ["target", "symptom"])
    names = b.groupBy("source", "target").agg(F.sort_array(F.collect_list("name")).alias("shared_names"))
    edges = chosen.join(names, ["source", "target"]).select(
        F.to_json(F.array(F.lit("derived"), "source", "target")).alias("id"), "source", "target", F.lit("SHARES_SYMPTOM").alias("relation"), F.lit(1.0).alias("confidence"), F.col("shared").alias("weight"), "shared_names"
    )
    ends = pairs.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return View(_used(g.nodes, edges), edges, None, _totals(ends, pairs))


def similarity(g: Graph, diseases: int = 120, most_edges: int = 220) -> DataFrame:
    """Edges of the similarity view: ``source, target, shared``."""
    return strongest(similar_pairs(g), diseases, most_edges)


def strongest(pairs: DataFrame, diseases: int = 120, most_edges: int = 220) -> DataFrame:
    """The strongest ``pairs`` among the diseases of highest weighted degree."""
    weight = pairs.select(F.explode(F.array("source", "target")).alias("id"), "shared").groupBy("id").agg(F.sum("shared").alias("w"))
    chosen = weight.orderBy(F.desc("w"), "id").limit(diseases).select("id")
    for side in ("source", "target"):
        pairs = pairs.join(F.broadcast(chosen.withColumnRenamed("id", side)), side, "left_semi")
    return pairs.orderBy(F.desc("shared"), "source", "target").limit(most_edges)


def adjacent(g: Graph, focus: DataFrame) -> DataFrame:
    """Edges with the focus (one row ``f``) at either end, by equality of their ends."""
    ends = g.edges.withColumn("_end", F.explode(F.array_distinct(F.array("source", "target"))))
    return ends.join(focus, F.col("_end") == F.col("f")).drop("_end")


def neighbourhood(g: Graph, focus: str | None = None, limit: int = 80) -> View:
    """The focus (default: highest degree), its neighbours of highest degree up to ``limit`` nodes, and all edges among
    them; the total counts the focus and all its neighbours."""
    d = g.nodes.join(degrees(g), "id")
    order = [F.desc("degree"), F.col("name"), F.col("type"), F.col("id")]
    first = (d.where(F.col("id") == focus) if focus else d.orderBy(*order)).limit(1).withColumn("is_focus", F.lit(1))
    f = F.broadcast(first.select(F.col("id").alias("f")))
    near = adjacent(g, f).select(F.when(F.col("source") == F.col("f"), F.col("target")).otherwise(F.col("source")).alias("id"), "f").where("id <> f").select("id").distinct()
    others = d.join(near, "id", "left_semi").withColumn("is_focus", F.lit(0))
    nodes = first.unionByName(others).orderBy(F.desc("is_focus"), *order).limit(max(1, limit))
    ids = F.broadcast(nodes.select("id"))
    edges = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return View(nodes.select("id", "name", "type", "degree"), edges, None, _totals(first.select("id").unionByName(near), edges))


def representative(g: Graph, most_nodes: int, most_edges: int) -> DataFrame:
    """Edges of the overview: by summed degree, confidence and id, each taken if its nodes still fit.

    An edge that would overflow the nodes is skipped, later ones may fit. Rows come to the driver in ranked order in
    batches and the choice ends when the edges are full, or when the nodes are full and no edge among them is left;
    the driver keeps no more than the chosen nodes and edges.
    """
    d = degrees(g)
    e = g.edges.join(d.select(F.col("id").alias("source"), F.col("degree").alias("ds")), "source").join(d.select(F.col("id").alias("target"), F.col("degree").alias("dt")), "target")
    # ranked once and written: every batch reads it
    ranked = materialize(e.select("source", "target", "id", "confidence", (F.col("ds") + F.col("dt")).alias("weight")), "ranked-edges")
    order = [F.desc("weight"), F.desc("confidence"), F.col("id")]
    visible: set[str] = set()
    edges: list[tuple[int, str, str, str]] = []
    # while nodes are not full every edge is taken or adds at most two nodes: the head decides them
    head = ranked.orderBy(*order).limit(most_edges + most_nodes).collect()
    last = None
    for r in head:
        last = r
        if len(edges) >= most_edges:
            break
        extra = (r.source not in visible) + (r.target not in visible)
        if len(visible) + extra > most_nodes:
            continue
        visible |= {r.source, r.target}
        edges.append((len(edges) + 1, r.id, r.source, r.target))
    spark = g.edges.sparkSession
    schema = "rank int, id string, source string, target string"
    while len(edges) < most_edges and last is not None:
        # only edges with at most as many unseen ends as there is room can still be taken
        room = most_nodes - len(visible)
        seen = F.broadcast(spark.createDataFrame([(v,) for v in sorted(visible)] or [("",)], "v string"))
        rest = ranked.where((F.col("weight") < last.weight) | ((F.col("weight") == last.weight) & ((F.col("confidence") < last.confidence) | ((F.col("confidence") == last.confidence) & (F.col("id") > last.id)))))
        rest = rest.join(seen.withColumnRenamed("v", "s"), F.col("source") == F.col("s"), "left").join(seen.withColumnRenamed("v", "t"), F.col("target") == F.col("t"), "left")
        new = F.col("s").isNull().cast("int") + F.col("t").isNull().cast("int")
        batch = rest.where(new <= room).orderBy(*order).limit(most_edges + most_nodes).collect()
        if not batch:
            break
        for r in batch:
            last = r
            if len(edges) >= most_edges:
                break
            extra = (r.source not in visible) + (r.target not in visible)
            if len(visible) + extra > most_nodes:
                continue
            visible |= {r.source, r.target}
            edges.append((len(edges) + 1, r.id, r.source, r.target))
    discard(ranked)
    return spark.createDataFrame(edges, schema)


def dashboard(g: Graph) -> DataFrame:
    """``panel, label, n``: nodes by type, edges by relation, isolated nodes, edges below 0.6, edges with evidence and
    their percentage; the panels in this order, their entries by descending number."""
    by_type = g.nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("type").alias("panel"), "label", "n")
    by_rel = g.edges.groupBy(F.col("relation").alias("label")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("panel"), "label", "n")
    alone = degrees(g).agg(F.count_if(F.col("degree") == 0).alias("n")).select(F.lit("isolated").alias("panel"), F.lit("").alias("label"), "n")
    low = g.edges.agg(F.count_if(F.col("confidence") < 0.6).alias("n")).select(F.lit("low_quality").alias("panel"), F.lit("").alias("label"), "n")
    proved = g.edges.agg(F.count_if(F.col("n_evidence") > 0).alias("n")).select(F.lit("with_evidence").alias("panel"), F.lit("").alias("label"), "n")
    share = F.when(F.count("*") > 0, F.floor(100 * F.count_if(F.col("n_evidence") > 0) / F.count("*") + 0.5)).otherwise(0).cast("long")
    percent = g.edges.agg(share.alias("n")).select(F.lit("evidence_percent").alias("panel"), F.lit("").alias("label"), "n")
    out = by_type.unionByName(by_rel).unionByName(alone).unionByName(low).unionByName(proved).unionByName(percent)
    panels = F.array(*(F.lit(x) for x in ("type", "relation", "isolated", "low_quality", "with_evidence", "evidence_percent")))
    return out.orderBy(F.array_position(panels, F.col("panel")), F.desc("n"), "label")


def filter_panel(g: Graph, steps: tuple[int, int] = (50, 81)) -> DataFrame:
    """``panel, label, n``: nodes of every type, edges of every relation, and for each hundredth of the slider the edges
    of at least that confidence."""
    by_type = g.nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("type").alias("panel"), "label", "n")
    by_rel = g.edges.groupBy(F.col("relation").alias("label")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("panel"), "label", "n")
    marks = list(range(steps[0], steps[1] + 1))
    counts = g.edges.agg(*(F.count_if(F.col("confidence") >= m / 100).alias(str(m)) for m in marks))
    slider = counts.select(F.explode(F.array(*(F.struct(F.lit(f"{m / 100:.2f}").alias("label"), F.col(str(m)).alias("n")) for m in marks))).alias("x")).select(F.lit("slider").alias("panel"), "x.*")
    return by_type.unionByName(by_rel).unionByName(slider)


def entity_detail(g: Graph, focus: DataFrame) -> DataFrame:
    """``relation, edges, evidence, documents`` of the edges of the focus (one row ``f``), by the relation's name."""
    near = adjacent(g, F.broadcast(focus))
    docs = near.select("source", "relation", "target").join(g.facts.where("source_document_id <> ''"), ["source", "relation", "target"])
    docs = docs.groupBy("relation").agg(F.count_distinct("source_document_id").alias("documents"))
    out = near.groupBy("relation").agg(F.count("*").alias("edges"), F.sum("n_evidence").alias("evidence"))
    return out.join(docs, "relation", "left").fillna(0, ["documents"]).orderBy("relation")


def packed(g: Graph) -> DataFrame:
    """``component, nodes, edges`` of the connected parts, the largest first; nodes without an edge are parts of their own."""
    linked = connected(g.edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    parts = g.nodes.select("id").join(linked, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
    n = parts.groupBy("component").agg(F.count("*").alias("nodes"))
    e = g.edges.join(parts, F.col("source") == parts["id"]).groupBy("component").agg(F.count("*").alias("edges"))
    return n.join(e, "component", "left").fillna(0, ["edges"]).orderBy(F.desc("nodes"), "component")


def drawn(g: Graph, focus: DataFrame) -> DataFrame:
    """``id, degree, size`` of the nodes as they are drawn: the size grows with the root of the degree, the focus is larger."""
    d = degrees(g).join(F.broadcast(focus), F.col("id") == F.col("f"), "left")
    size = F.least(F.lit(34.0), 10 + 3 * F.sqrt("degree") + F.when(F.col("f").isNotNull(), 8.0).otherwise(0.0))
    return d.select("id", "degree", size.alias("size"))


def edge_width(weight: Column) -> Column:
    """Width of a derived edge."""
    return F.least(F.lit(7.0), 1.2 + 1.35 * F.log2(weight))


def core_entities(g: Graph, most: int = 5) -> DataFrame:
    return g.nodes.join(degrees(g), "id").orderBy(F.desc("degree"), "name", "type", "id").limit(most).select("id", "name", "type", "degree")


def ordered_nodes(g: Graph) -> DataFrame:
    """Directory order of nodes with their position (binary order of name, type, id).

    Positions come from a range-partitioned sort and per-partition offsets, not from one task.
    """
    cut = g.nodes.select("id", "name", "type").repartitionByRange("name", "type", "id").sortWithinPartitions("name", "type", "id").withColumn("part", F.spark_partition_id())
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("name", "type", "id"))
    return cut.withColumn("local", local).join(F.broadcast(offsets), "part").select((F.col("before") + F.col("local")).alias("position"), "id", "name", "type")

"""Queries over facts: rules, merges, quality, stored tables - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ontology
from ..functions.text import stripped
from ..operators import assess, dedupe, rules, store
from ..runtime import materialize, table
from . import sql

Q: dict = {}
SQL: dict[str, str] = {}
FACT = ["id", "subject", "subject_type", "relation", "object", "object_type", "source_document_id", "confidence", "layer"]


def query(text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _t(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples")


def titles(spark: SparkSession, d: str) -> DataFrame:
    """One title per document_id: that of its first row."""
    docs = table(spark, d, "documents").where("document_id IS NOT NULL")
    return docs.groupBy("document_id").agg(F.min_by(F.coalesce("title", F.lit("")), "doc_id").alias("title"))


TITLES = "titles AS (SELECT document_id, arg_min(coalesce(title, ''), doc_id) AS title FROM documents WHERE document_id IS NOT NULL GROUP BY document_id)"


@query("SELECT id, subject, subject_type, relation, object, object_type, source_document_id, source_text, confidence, layer FROM triples")
def project_triples(spark, d):
    return _t(spark, d).drop("trained")


@query(f"WITH {TITLES} SELECT document_id, title FROM titles")
def title_lookup(spark, d):
    return titles(spark, d)


@query("SELECT id, subject, relation, object, source_document_id FROM triples WHERE relation = 'HAS_SYMPTOM' AND subject = '弥漫性络脉钝化病'")
def triple_query_optional(spark, d):
    return rules.query_triples(_t(spark, d), relation="HAS_SYMPTOM", subject="弥漫性络脉钝化病", object="", source_document_id=None).select("id", "subject", "relation", "object", "source_document_id")


@query(f"SELECT id FROM triples WHERE {sql.VALID}")
def valid_triples(spark, d):
    return rules.valid(_t(spark, d)).select("id")


@query("SELECT id FROM triples WHERE coalesce(subject,'') <> '' AND coalesce(relation,'') <> '' AND coalesce(object,'') <> ''")
def valid_triples_stored(spark, d):
    return rules.valid(_t(spark, d), trimmed=False).select("id")


def _rejects(spark, d):
    """The review list of these queries: every fact of low confidence."""
    return _t(spark, d).where("confidence < 0.4")


_G = sql.names(rules.GENERIC)
_C = sql.names(rules.CLINICAL)
FLAGS = f"""
{TITLES},
x AS (SELECT t.*, {sql.s('t.subject')} AS s, {sql.s('t.object')} AS o, coalesce(t.subject_type,'') AS st, coalesce(t.object_type,'') AS ot, coalesce(titles.title,'') AS ti
      FROM triples t LEFT JOIN titles ON titles.document_id = t.source_document_id),
flags AS (SELECT id, confidence, list_filter([
   CASE WHEN (s IN {_G} AND st IN {_C}) OR (o IN {_G} AND ot IN {_C}) THEN 'generic' END,
   CASE WHEN s <> '' AND st IN {sql.names(rules.SUFFIX_TYPES)} AND {sql.ends('s', rules.DISCIPLINE_ENDS)} THEN 'suffix' END,
   CASE WHEN s <> '' AND s = ti AND {sql.ends('ti', rules.TITLE_ENDS)} THEN 'doc_title' END,
   CASE WHEN ot <> 'Drug' AND contains(o, '、') THEN 'fragment' END,
   CASE WHEN confidence < 0.4 THEN 'review' END,
   CASE WHEN s IN {sql.names(rules.SYNDROMES)} AND st = 'Disease' THEN 'tcm_syndrome' END], lambda r: r IS NOT NULL) AS broken FROM x)
"""


def _flagged(spark, d):
    return rules.broken_rules(_t(spark, d), titles(spark, d), _rejects(spark, d))


@query(f"WITH {FLAGS} SELECT id, array_to_string(broken, ',') AS broken FROM flags")
def rule_flags(spark, d):
    return _flagged(spark, d).select("id", F.array_join("broken", ",").alias("broken"))


@query(f"WITH {FLAGS} SELECT id FROM flags WHERE len(broken) = 0")
def rule_filtered(spark, d):
    return _flagged(spark, d).where(F.size("broken") == 0).select("id")


@query(f"WITH {FLAGS} SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(broken) AS rule FROM flags) GROUP BY rule")
def rule_stats(spark, d):
    return rules.rule_counts(_flagged(spark, d))


_RT = (sql.resolve_relation("relation"), sql.resolve_type("subject_type"), sql.resolve_type("object_type"))


@query(f"SELECT id FROM (SELECT id, {_RT[0]} AS r, {_RT[1]} AS st, {_RT[2]} AS ot FROM triples) WHERE {sql.fits('r', 'st', 'ot')}")
def relation_valid(spark, d):
    return rules.ontology_valid(_t(spark, d)).select("id")


@query(f"SELECT DISTINCT relation, {_RT[0]} AS resolved FROM triples")
def resolve_relations(spark, d):
    return _t(spark, d).select("relation", ontology.resolve_relation(F.col("relation")).alias("resolved")).distinct()


@query(
    f"SELECT DISTINCT object_type, {_RT[2]} AS resolved, coalesce({sql.case_map(_RT[2], ontology.ENTITY_TYPES)}, object_type) AS label FROM triples"
)
def resolve_types(spark, d):
    return _t(spark, d).select("object_type", ontology.resolve_type(F.col("object_type")).alias("resolved"), ontology.type_label(F.col("object_type")).alias("label")).distinct()


@query(f"WITH {TITLES} SELECT t.id, t.subject, coalesce(x.title, '') AS title FROM triples t LEFT JOIN titles x ON x.document_id = t.source_document_id")
def title_left(spark, d):
    t, x = _t(spark, d), titles(spark, d).withColumnRenamed("document_id", "k")
    return t.join(x, t["source_document_id"] == x["k"], "left").select("id", "subject", F.coalesce("title", F.lit("")).alias("title"))


@query("SELECT id, subject, relation, object FROM triples WHERE confidence < 0.4")
def review_semi(spark, d):
    return _flagged(spark, d).where(F.array_contains("broken", "review")).select("id", "subject", "relation", "object")


_KEEP = f"row_number() OVER (PARTITION BY {sql.s('subject')}, {sql.s('relation')}, {sql.s('object')} ORDER BY coalesce(confidence, 0) DESC, id)"


@query(f"SELECT id, CASE WHEN {_KEEP} = 1 THEN 'keep' ELSE 'delete' END AS action FROM triples")
def keep_best(spark, d):
    return dedupe.keep_best(_t(spark, d)).select("id", "action")


@query("SELECT id FROM (SELECT id, " + _KEEP.replace(f"{sql.s('relation')}, ", "") + " AS r FROM triples) WHERE r = 1")
def keep_best_pairs(spark, d):
    return dedupe.keep_best(_t(spark, d), ("subject", "object")).where("action = 'keep'").select("id")


_PASS1 = """
m AS (SELECT *, min(id) OVER w AS first_pos, row_number() OVER (PARTITION BY subject, relation, object, object_type
   ORDER BY coalesce(confidence,0) DESC, CASE WHEN layer = 'rule' THEN 1 ELSE 0 END DESC, CASE WHEN layer = 'rule' THEN -id ELSE id END) AS r
   FROM triples WINDOW w AS (PARTITION BY subject, relation, object, object_type)),
p1 AS (SELECT * FROM m WHERE r = 1)
"""


@query(f"WITH {_PASS1} SELECT id, first_pos FROM p1")
def layer_merge_exact(spark, d):
    return dedupe.merge_exact(_t(spark, d)).select("id", "first_pos")


_SPEC = "CASE relation " + " ".join(f"WHEN '{r}' THEN {v[3]}" for r, v in ontology.RELATIONS.items()) + " ELSE 0 END"


@query(f"""WITH {_PASS1} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY subject, object ORDER BY {_SPEC} DESC, coalesce(confidence,0) DESC,
   CASE WHEN coalesce(layer = 'deep_learning', false) THEN 1 ELSE 0 END, first_pos) AS r2 FROM p1) WHERE r2 = 1""")
def layer_merge_relations(spark, d):
    return dedupe.merge_layers(_t(spark, d)).select("id")


@query("""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY subject, subject_type, relation, object, object_type ORDER BY id) AS r FROM triples
  WHERE coalesce(subject,'') <> '' AND coalesce(subject_type,'') <> '' AND coalesce(relation,'') <> '' AND coalesce(object,'') <> '' AND coalesce(object_type,'') <> '') WHERE r = 1""")
def first_seen(spark, d):
    return dedupe.first_seen(_t(spark, d), ("subject", "subject_type", "relation", "object", "object_type"), "id").select("id")


@query("SELECT id, relation FROM (SELECT id, relation, row_number() OVER (PARTITION BY relation ORDER BY id) AS r FROM triples) WHERE r <= 3")
def capped_per_group(spark, d):
    return dedupe.capped(_t(spark, d), "relation", "id", 3).select("id", "relation")


CONFLICTS = f"""
o AS (SELECT {sql.s('subject')} AS name, {sql.kind('subject_type')} AS type, 2*id AS pos FROM triples WHERE {sql.VALID}
      UNION ALL SELECT {sql.s('object')}, {sql.kind('object_type')}, 2*id+1 FROM triples WHERE {sql.VALID}),
b AS (SELECT name, type, count(*) AS n, min(pos) AS first FROM o GROUP BY name, type),
c AS (SELECT name AS entity, count(*) AS n_types, string_agg(type || '=' || n, ';' ORDER BY type || '=' || n) AS observed,
       arg_max(type, struct_pack(a := n, b := -first)) AS suggested_type, CASE WHEN max(n) >= 3*min(n) THEN 'high' ELSE 'medium' END AS severity FROM b GROUP BY name HAVING count(*) > 1)
"""


@query(f"WITH {CONFLICTS} SELECT entity, n_types, observed, suggested_type, severity FROM c")
def type_conflicts(spark, d):
    return assess.type_conflicts(_t(spark, d))


SUPPORT = f"""
g AS (SELECT {sql.s('subject')} AS subject, {sql.s('relation')} AS relation, {sql.s('object')} AS object,
   count(DISTINCT CASE WHEN {sql.s('source_document_id')} <> '' THEN {sql.s('source_document_id')} END) AS support_document_count,
   count(DISTINCT CASE WHEN {sql.s('source_text')} <> '' THEN {sql.s('source_document_id')} || chr(1) || {sql.s('source_text')} END) AS support_evidence_count
   FROM triples WHERE {sql.VALID} GROUP BY 1, 2, 3)
"""


@query(f"WITH {SUPPORT} SELECT * FROM g")
def support(spark, d):
    return assess.support(_t(spark, d))


SCORED = f"""
{CONFLICTS}, {SUPPORT},
y AS (SELECT t.id, t.subject, t.relation, t.object, g.support_document_count AS nd, g.support_evidence_count AS ne, length({sql.s('t.source_text')}) AS tl,
   {sql.mismatched(sql.s('t.relation'), sql.kind('t.subject_type'), sql.kind('t.object_type'))} AS mis,
   ({sql.s('t.subject')} IN (SELECT entity FROM c) OR {sql.s('t.object')} IN (SELECT entity FROM c)) AS con
   FROM triples t JOIN g ON g.subject = {sql.s('t.subject')} AND g.relation = {sql.s('t.relation')} AND g.object = {sql.s('t.object')}),
z AS (SELECT *, 0.30::DOUBLE*0.78::DOUBLE + 0.25::DOUBLE*(CASE WHEN nd > 0 THEN least(1.0::DOUBLE, 0.55::DOUBLE + 0.12::DOUBLE*least(nd, 4)) ELSE 0.0::DOUBLE END) + 0.20::DOUBLE*0.8::DOUBLE
   + 0.15::DOUBLE*(CASE WHEN tl > 0 THEN least(1.0::DOUBLE, 0.35::DOUBLE + tl/70.0::DOUBLE) ELSE 0.0::DOUBLE END) + 0.10::DOUBLE*(CASE WHEN mis THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END)
   - (CASE WHEN con THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) AS s0 FROM y),
sc AS (SELECT *, greatest(0.0, least(1.0, floor((CASE WHEN nd = 0 OR tl = 0 THEN least(s0, 0.59::DOUBLE) ELSE s0 END) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE)) AS confidence,
   array_to_string(list_filter([CASE WHEN mis THEN 'entity_type_mismatch' END, CASE WHEN con THEN 'entity_type_conflict' END, CASE WHEN nd = 0 THEN 'no_source_document' END,
     CASE WHEN tl = 0 THEN 'no_evidence' WHEN tl < 12 THEN 'short_evidence' END, CASE WHEN nd = 1 THEN 'single_source' END], lambda f: f IS NOT NULL), ',') AS quality_flags FROM z)
"""


@query(f"WITH {SCORED} SELECT id, quality_flags, nd AS support_document_count, ne AS support_evidence_count, CASE WHEN quality_flags <> '' THEN 'warning' ELSE 'unreviewed' END AS review_status FROM sc")
def quality_flags(spark, d):
    return assess.assess(_t(spark, d)).select("id", "quality_flags", "support_document_count", "support_evidence_count", "review_status")


@query(f"WITH {SCORED} SELECT id, subject, relation, object, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'review' END AS confidence_level FROM sc")
def triple_score(spark, d):
    return assess.assess(_t(spark, d)).select("id", "subject", "relation", "object", "confidence", "confidence_level")


BEST = f"best AS (SELECT * FROM triples QUALIFY {_KEEP} = 1)"


def quality_graph(spark, d):
    """The flagship: valid facts, the best of each kept, scored with support, conflicts and flags."""
    best = dedupe.keep_best(rules.valid(_t(spark, d))).where("action = 'keep'").drop("action")
    # the winners are read by support, conflicts and scores
    return assess.assess(materialize(best, "best-facts")).select("id", "subject", "relation", "object", "confidence", "confidence_level", "quality_flags", "support_document_count")


Q["quality_graph"] = quality_graph
SQL["quality_graph"] = f"WITH triples AS (SELECT * FROM triples WHERE {sql.VALID} QUALIFY {_KEEP} = 1), {SCORED} SELECT id, subject, relation, object, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'review' END AS confidence_level, quality_flags, nd AS support_document_count FROM sc"


@query("""SELECT t.id, e.id AS evidence_id, t.subject, t.relation, t.object, CASE WHEN coalesce(e.source_document_id,'') <> '' THEN e.source_document_id ELSE t.source_document_id END AS source_document_id,
  CASE WHEN coalesce(e.source_text,'') <> '' THEN e.source_text ELSE t.source_text END AS source_text FROM triples t LEFT JOIN triple_evidence e ON e.triple_id = t.id""")
def evidence_export(spark, d):
    return store.export_facts(_t(spark, d), table(spark, d, "triple_evidence")).select("id", "evidence_id", "subject", "relation", "object", "source_document_id", "source_text")


@query("""SELECT triple_id, source_document_id, source_text, min(id) AS id FROM triple_evidence WHERE triple_id IS NOT NULL AND source_document_id IS NOT NULL AND source_text IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL SELECT triple_id, source_document_id, source_text, id FROM triple_evidence WHERE triple_id IS NULL OR source_document_id IS NULL OR source_text IS NULL""")
def evidence_distinct(spark, d):
    return store.distinct_evidence(table(spark, d, "triple_evidence")).select("triple_id", "source_document_id", "source_text", "id")


@query("""WITH old AS (SELECT * FROM triples WHERE layer = 'rule'), new AS (SELECT * FROM triples WHERE coalesce(layer,'') <> 'rule'),
 f AS (SELECT *, CASE WHEN subject IS NULL OR relation IS NULL OR object IS NULL OR object_type IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY subject, relation, object, object_type ORDER BY id) END AS r FROM new)
 SELECT id FROM f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.subject = f.subject AND o.relation = f.relation AND o.object = f.object AND o.object_type = f.object_type)""")
def insert_or_ignore(spark, d):
    t = _t(spark, d)
    return store.insert_or_ignore(t.where("layer = 'rule'"), t.where("coalesce(layer, '') <> 'rule'")).select("id")


@query("SELECT id, coalesce(trained, 0) + CASE WHEN id IN (SELECT triple_id FROM triple_evidence) THEN 1 ELSE 0 END AS trained FROM triples")
def trained_bump(spark, d):
    return store.bump_trained(_t(spark, d), table(spark, d, "triple_evidence").select(F.col("triple_id").alias("id"))).select("id", "trained")


@query(f"SELECT id FROM triples WHERE id NOT IN (SELECT id FROM (SELECT id, {_KEEP} AS r FROM triples) WHERE r > 1)")
def delete_duplicates(spark, d):
    losers = dedupe.keep_best(_t(spark, d)).where("action = 'delete'")
    return store.delete_by_id(_t(spark, d), losers).select("id")


@query("SELECT DISTINCT source_document_id FROM triples WHERE source_document_id IS NOT NULL")
def distinct_sources(spark, d):
    return _t(spark, d).select("source_document_id").where("source_document_id IS NOT NULL").distinct()


@query("SELECT layer, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM triples GROUP BY layer")
def layer_summary(spark, d):
    return _t(spark, d).groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


@query("SELECT subject, object, count(*) AS n, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM triples GROUP BY subject, object HAVING count(*) > 1")
def duplicate_pairs(spark, d):
    return _t(spark, d).groupBy("subject", "object").agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_set("layer")), ","), F.lit("")).alias("layers")).where("n > 1")


@query("SELECT id, subject, subject_type, relation, object, object_type, source_document_id, source_text, confidence, layer, CAST(NULL AS VARCHAR) AS review FROM triples ORDER BY id")
def review_export(spark, d):
    """Every fact in the order of its id, the verdict left open."""
    return _t(spark, d).drop("trained").withColumn("review", F.lit(None).cast("string")).orderBy("id")


_CAND = "cand AS (SELECT f.id, t.subject, t.subject_type, t.relation, t.object, t.object_type, t.source_document_id, t.source_text, array_to_string(f.broken, ',') AS rules FROM flags f JOIN triples t USING (id) WHERE len(f.broken) > 0)"


@query(f"WITH {FLAGS}, {_CAND} SELECT * FROM cand")
def clean_candidates(spark, d):
    """The rows of the cleaning report: every fact that breaks a rule, with its rules."""
    return rules.candidates(_flagged(spark, d)).withColumn("rules", F.array_join("rules", ","))


@query(f"WITH {FLAGS}, {_CAND} SELECT id, subject, object, rules FROM cand ORDER BY len(string_split(rules, ',')) DESC, id LIMIT 20")
def clean_report_head(spark, d):
    """The report's head: the facts that break most rules."""
    c = rules.candidates(_flagged(spark, d))
    return c.orderBy(F.desc(F.size("rules")), "id").limit(20).select("id", "subject", "object", F.array_join("rules", ",").alias("rules"))


@query(f"WITH {FLAGS} SELECT count(*) AS db_total, count(*) FILTER (WHERE len(broken) > 0) AS candidate_total FROM flags")
def clean_totals(spark, d):
    return _flagged(spark, d).agg(F.count("*").alias("db_total"), F.count_if(F.size("broken") > 0).alias("candidate_total"))


@query(f"""WITH k AS (SELECT {sql.s('subject')} AS subject, {sql.s('relation')} AS relation, {sql.s('object')} AS object, id, count(*) OVER (PARTITION BY {sql.s('subject')}, {sql.s('relation')}, {sql.s('object')}) AS group_size FROM triples WHERE {sql.VALID})
  SELECT id, group_size FROM k""")
def group_enrich(spark, d):
    t = rules.valid(_t(spark, d)).select("id", *(stripped(F.col(c)).alias(c) for c in ("subject", "relation", "object")))
    g = t.groupBy("subject", "relation", "object").agg(F.count("*").alias("group_size"))
    return t.join(g, ["subject", "relation", "object"]).select("id", "group_size")


@query("SELECT term, type, n FROM (SELECT object AS term, object_type AS type, count(*) AS n, min(id) AS f, row_number() OVER (PARTITION BY object ORDER BY count(*) DESC, min(id)) AS r FROM triples WHERE object IS NOT NULL AND object_type IS NOT NULL GROUP BY object, object_type) WHERE r = 1 AND n >= 2")
def majority_vote(spark, d):
    from ..operators import labels

    votes = _t(spark, d).where("object IS NOT NULL AND object_type IS NOT NULL").select(F.col("object").alias("term"), F.col("object_type").alias("type"), "id")
    return labels.majority(votes, "id")


@query("WITH n AS (SELECT coalesce(object_type, 'O') AS label, count(*) AS n FROM triples GROUP BY 1) SELECT label, n, CASE WHEN label = 'O' THEN 1.0 ELSE (SELECT sum(n) FROM n)::DOUBLE / n END AS weight FROM n")
def class_weights(spark, d):
    from ..operators import labels

    return labels.class_weights(_t(spark, d).select(F.coalesce("object_type", F.lit("O")).alias("label")))

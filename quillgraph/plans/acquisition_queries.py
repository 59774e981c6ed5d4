"""Queries over plans, batches, exports, publication and the extraction layers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import acquire, collect, extract, publication
from ..runtime import shared_dir, table
from ..sources import text_files
from . import sql
from .acceptance_queries import _CODE

Q: dict = {}
SQL: dict[str, str] = {}


def query(text_: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if text_:
            SQL[f.__name__] = text_
        return f

    return add


def _catalog(spark, d):
    return collect.catalog(table(spark, d, "clc_r_categories"))


_CAT = f"""cat AS (SELECT {sql.squeeze('category_id')} AS category_id, {_CODE.format(sql.squeeze('clc_code'))} AS clc_code, {sql.squeeze('clc_name')} AS clc_name, target_count, lower({sql.squeeze('reviewed')}) IN ('1', 'true', 'yes', 'y') AS reviewed,
  list_filter(list_transform(string_split(query_terms, '|'), lambda x: {sql.squeeze('x')}), lambda x: x <> '') AS terms FROM clc_r_categories)"""
_HINT = f"'{acquire.EXPORT_QUERY[0]}' || clc_code || '{acquire.EXPORT_QUERY[1]}' || array_to_string(terms, ' OR ')"


@query(f"WITH {_CAT} SELECT category_id, clc_code, clc_name, target_count, array_to_string(terms, '|') AS query_terms, {_HINT} AS recommended_query, category_id || '__batch001.txt' AS suggested_export_file FROM cat")
def collection_plan(spark, d):
    return acquire.collection_plan(_catalog(spark, d), True)


@query(f"WITH {_CAT} SELECT 'cnki_' || category_id || '_001' AS batch_id, category_id || '__batch001.txt' AS file, category_id, {_HINT} AS query_text, 'export' AS access_basis, '' AS rights_statement FROM cat")
def batch_template(spark, d):
    return acquire.batch_template(_catalog(spark, d), "export")


def _manifest(spark, d):
    """A manifest filled from the raw catalog: its codes, parents and sources stand where a person's entries would."""
    c = table(spark, d, "clc_r_categories")
    return c.select(
        F.col("category_id").alias("pos"), F.concat(F.col("authority_source"), F.lit("_"), "parent_code").alias("batch_id"), F.concat(F.when(F.col("enabled") == "true", "").otherwise("../"), "category_id", F.lit(".txt")).alias("file"),
        F.when(F.col("reviewed") == "true", F.col("category_id")).otherwise(F.upper("category_id")).alias("category_id"), F.concat(F.lit("CLC="), F.coalesce("clc_code", F.lit("")), F.lit(" "), F.coalesce("parent_code", F.lit(""))).alias("query_text"),
    )


@query(f"""WITH {_CAT}, m AS (SELECT category_id AS pos, {sql.squeeze("authority_source || '_' || parent_code")} AS batch_id, {sql.squeeze("CASE WHEN enabled = 'true' THEN '' ELSE '../' END || category_id || '.txt'")} AS file,
   {sql.squeeze("CASE WHEN reviewed = 'true' THEN category_id ELSE upper(category_id) END")} AS category_id, {sql.squeeze("'CLC=' || coalesce(clc_code, '') || ' ' || coalesce(parent_code, '')")} AS query_text FROM clc_r_categories),
  n AS (SELECT m.*, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS nth FROM m)
  SELECT batch_id, file, n.category_id, array_to_string(list_filter([CASE WHEN batch_id = '' OR file = '' OR n.category_id = '' OR query_text = '' THEN 'empty_field' END, CASE WHEN nth > 1 AND batch_id <> '' THEN 'repeated_batch' END, CASE WHEN cat.category_id IS NULL THEN 'unknown_category' END,
   CASE WHEN coalesce(clc_code, '') <> '' AND NOT regexp_matches(' ' || upper(query_text) || ' ', '[^A-Z0-9.]' || regexp_escape(clc_code) || '[^A-Z0-9.]') THEN 'code_not_declared' END, CASE WHEN starts_with(file, '../') THEN 'outside_inbox' END], lambda x: x IS NOT NULL), ',') AS faults
  FROM n LEFT JOIN cat ON cat.category_id = n.category_id""")
def batch_manifest(spark, d):
    return acquire.manifest_faults(_manifest(spark, d), _catalog(spark, d)).withColumn("faults", F.array_join("faults", ","))


@query(f"WITH {_CAT} SELECT count(*) FILTER (WHERE reviewed) AS reviewed, count(*) FILTER (WHERE reviewed AND target_count >= 50) AS eligible, coalesce(sum(target_count) FILTER (WHERE reviewed), 0)::BIGINT AS capacity, CASE WHEN count(*) FILTER (WHERE reviewed) < 20 THEN 'too_few_reviewed' WHEN count(*) FILTER (WHERE reviewed AND target_count >= 50) < 20 THEN 'too_few_eligible' WHEN coalesce(sum(target_count) FILTER (WHERE reviewed), 0) < 3000 THEN 'too_small' END AS fault FROM cat")
def capacity(spark, d):
    return acquire.capacity(_catalog(spark, d), 20, 3000, 50)


def _export_files(spark, d):
    """Every document as a file of the tagged form, its fields on lines of their own."""
    field = lambda tag, c: F.concat(F.lit(f"{tag} "), F.coalesce(F.col(c), F.lit("")))
    lines = F.concat_ws("\r\n", F.lit("RT Journal"), field("T1", "title"), field("AB", "content"), F.concat(F.lit("a1 "), F.coalesce("source", F.lit("")), F.lit("；"), F.coalesce("lang", F.lit(""))), field("UL", "source_url"), field("ID", "document_id"), F.lit("ER"))
    return table(spark, d, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), lines.alias("content"))


_PLAIN = "regexp_replace({0}, '[\\r\\n]', ' ', 'g')"


@query(f"""SELECT doc_id || '.txt' AS path, {sql.squeeze('title')} AS title, {sql.squeeze('content')} AS abstract, array_to_string(list_distinct_in_order, '|') AS authors, {sql.squeeze('document_id')} AS source_record_id FROM
  (SELECT *, CASE WHEN {sql.squeeze('source')} = {sql.squeeze('lang')} AND {sql.squeeze('lang')} <> '' THEN [{sql.squeeze('source')}] ELSE list_filter([{sql.squeeze('source')}, {sql.squeeze('lang')}], lambda x: x <> '') END AS list_distinct_in_order FROM documents)
  WHERE {sql.squeeze('document_id')} <> ''""")
def tagged_exports(spark, d):
    """Tagged exports of all documents, parsed and mapped to candidates."""
    r = text_files.source_records(text_files.tagged_records(_export_files(spark, d)))
    found = r.where(~F.col("source_record_id").rlike("^(doi|url|derived):"))
    return found.select("path", "title", "abstract", F.array_join("authors", "|").alias("authors"), "source_record_id")


def _work(spark, name):
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/quillgraph/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, document_id, title, content FROM documents")
def json_lines_round_trip(spark, d):
    """Documents written as JSON lines and read again, a line that is no object being an error."""
    path = _work(spark, "json-lines")
    table(spark, d, "documents").select("doc_id", "document_id", "title", "content").write.json(path)
    return text_files.read_json_lines(spark, path, "doc_id long, document_id string, title string, content string", strict=True)


@query("SELECT category_id, clc_code, clc_name, parent_code, query_terms, target_count, enabled, authority_source, reviewed FROM clc_r_categories")
def catalog_round_trip(spark, d):
    """The catalog written as CSV with a header and read again."""
    path = _work(spark, "catalog")
    table(spark, d, "clc_r_categories").select(*(c.split()[0] for c in text_files.CATALOG.split(", "))).write.option("header", True).option("escape", '"').csv(path)
    return text_files.read_catalog(spark, path)


@query(f"SELECT d.doc_id, d.title, e.id AS search_rank, e.source_text AS search_snippet FROM documents d LEFT JOIN (SELECT source_document_id AS k, id, source_text FROM triple_evidence WHERE source_document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_document_id ORDER BY id DESC) = 1) e ON e.k = d.document_id")
def search_hits(spark, d):
    """Pages with the rank and snippet of their hit: documents with the evidence that names them."""
    hits = table(spark, d, "triple_evidence").select(F.col("source_document_id").alias("page_id"), F.col("id").alias("search_rank"), F.col("source_text").alias("search_snippet"))
    pages = table(spark, d, "documents").select("doc_id", "title", F.col("document_id").alias("page_id"))
    return acquire.pages_with_hits(pages, hits).drop("page_id")


_REC = f"""rec AS (SELECT run_id || '/' || source_name AS term, row_number() OVER (PARTITION BY run_id, source_name ORDER BY created_at, document_id) AS rank, document_id, json_extract_string(canonical_json, '$.bibliography.title') AS title, json_extract_string(canonical_json, '$.text.content') AS content, content_hash FROM records WHERE document_id IS NOT NULL),
  a AS (SELECT * FROM rec WHERE document_id NOT IN (SELECT document_id FROM documents WHERE document_id IS NOT NULL) AND coalesce(title NOT IN (SELECT title FROM documents WHERE title IS NOT NULL), true) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY term, rank) = 1),
  b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank, document_id) <= 2),
  c AS (SELECT * FROM b WHERE length({sql.squeeze('content')}) >= 80 QUALIFY content_hash IS NULL OR row_number() OVER (PARTITION BY content_hash ORDER BY term, rank, document_id) = 1)"""


@query(f"WITH {_REC} SELECT term, rank, document_id, title FROM c")
def acquired(spark, d):
    """New records, at most two of a run's source, with unknown ids, titles and texts."""
    from pyspark.sql import Window

    r = table(spark, d, "records").where("document_id IS NOT NULL")
    at = lambda p: F.get_json_object("canonical_json", p)
    rank = F.row_number().over(Window.partitionBy("run_id", "source_name").orderBy("created_at", "document_id"))
    c = r.select(F.concat("run_id", F.lit("/"), "source_name").alias("term"), rank.alias("rank"), "document_id", at("$.bibliography.title").alias("title"), at("$.text.content").alias("content"), "content_hash")
    return acquire.unseen(c, table(spark, d, "documents").select("document_id", "title")).select("term", "rank", "document_id", "title")


@query()
def sample_pages(spark, d):
    """A sample of documents different by text and by URL, capped by category."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("category_id"), "title", "content", "source_url")
    return acquire.sampled(docs, "doc_id", 50, 300)


@query("SELECT document_id AS id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM documents")
def documents_export(spark, d):
    return publication.documents_export(table(spark, d, "documents"))


@query(f"SELECT document_id, doc_id, title FROM documents WHERE {sql.s('document_id')} <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY doc_id DESC) = 1")
def document_index(spark, d):
    """The point lookup of documents: of several rows of an id the last."""
    return publication.document_index(table(spark, d, "documents").select("document_id", "doc_id", "title"))


def _batch(spark, d):
    e = table(spark, d, "triple_evidence").alias("e").join(table(spark, d, "triples").alias("t"), F.col("e.triple_id") == F.col("t.id"))
    object_type = F.when(F.col("e.source_text").isNull(), F.lit("Unknown")).otherwise(F.col("t.object_type"))
    return e.select(F.col("e.id").alias("pos"), "t.subject", "t.subject_type", "t.relation", "t.object", object_type.alias("object_type"), F.col("e.source_document_id"), F.col("e.source_text"))


_INS = """b AS (SELECT e.id AS pos, t.subject, t.subject_type, t.relation, t.object, CASE WHEN e.source_text IS NULL THEN 'Unknown' ELSE t.object_type END AS object_type, e.source_document_id, e.source_text FROM triple_evidence e JOIN triples t ON t.id = e.triple_id
    WHERE coalesce(t.subject, '') <> '' AND coalesce(t.relation, '') <> '' AND coalesce(t.object, '') <> ''),
  n0 AS (SELECT * FROM b WHERE object_type IS NULL OR (subject, relation, object, object_type) NOT IN (SELECT (subject, relation, object, object_type) FROM triples WHERE subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL AND object_type IS NOT NULL)),
  n AS (SELECT *, (SELECT max(id) FROM triples) + row_number() OVER (ORDER BY pos) AS id FROM n0 QUALIFY object_type IS NULL OR row_number() OVER (PARTITION BY subject, relation, object, object_type ORDER BY pos) = 1)"""


@query(f"WITH {_INS} SELECT id, subject, relation, object, object_type FROM triples UNION ALL SELECT id, subject, relation, object, object_type FROM n")
def insert_facts(spark, d):
    """A batch of facts into the stored ones: new keys get the next ids."""
    t, _ = publication.insert_facts(table(spark, d, "triples"), table(spark, d, "triple_evidence"), _batch(spark, d))
    return t.select("id", "subject", "relation", "object", "object_type")


@query(f"""WITH {_INS}, f AS (SELECT id, subject, relation, object, object_type FROM triples UNION ALL SELECT id, subject, relation, object, object_type FROM n),
  p AS (SELECT DISTINCT f.id AS triple_id, b.source_document_id, b.source_text FROM b JOIN f USING (subject, relation, object, object_type) UNION SELECT id, source_document_id, source_text FROM n WHERE object_type IS NULL)
  SELECT triple_id, source_document_id, source_text FROM triple_evidence UNION ALL SELECT * FROM p WHERE triple_id IS NULL OR source_document_id IS NULL OR source_text IS NULL
   OR (triple_id, source_document_id, source_text) NOT IN (SELECT (triple_id, source_document_id, source_text) FROM triple_evidence WHERE triple_id IS NOT NULL AND source_document_id IS NOT NULL AND source_text IS NOT NULL)""")
def insert_evidence(spark, d):
    """The evidence after the same batch: every row proves its fact, old or new."""
    return publication.insert_facts(table(spark, d, "triples"), table(spark, d, "triple_evidence"), _batch(spark, d))[1]


@query(f"SELECT category_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(list_transform(string_split(query_terms, '|'), lambda x: {sql.squeeze('x')}), lambda x: x <> '')), lambda t: (-length(t), t))), lambda p: p[2]), '|') AS terms FROM clc_r_categories")
def terms_by_length(spark, d):
    terms = F.filter(F.transform(F.split("query_terms", "\\|"), text.squeeze), lambda t: t != "")
    return table(spark, d, "clc_r_categories").select("category_id", F.array_join(extract.ordered_terms(terms), "|").alias("terms"))


def _parts(spark, d):
    # bounded by the fixed table of categories
    return sorted({r.p for r in table(spark, d, "clc_r_categories").select(F.regexp_replace("clc_name", "(保健|病学|康复|药理|检验)$", "").alias("p")).collect()})


def _spans(spark, d):
    """Spans of a tagger with the corpus' own endings: a stand-in for a model."""
    lexicon = {"Symptom": ("钝痛", "跳痛", "刺痒", "发凉", "麻胀"), "RiskFactor": tuple(_parts(spark, d))}
    docs = table(spark, d, "documents")
    return docs, extract.tag_spans(extract.sentence_rows(docs, content="text"), extract.lexicon_tagger(lexicon))


@query()
def span_layer_facts(spark, d):
    """Facts of the span layer over whole texts: noise left out, sure spans paired."""
    docs, spans = _spans(spark, d)
    return extract.span_layer(spans, docs)[0]


@query()
def routed_sentences(spark, d):
    """Sentences that the span layer hands to the next one."""
    docs, spans = _spans(spark, d)
    return extract.span_layer(spans, docs)[1]


@query()
def routing_rate(spark, d):
    docs, spans = _spans(spark, d)
    routed = extract.span_layer(spans, docs)[1].agg(F.count("*").alias("routed"))
    every = extract.sentence_rows(docs, content="text").agg(F.count("*").alias("sentences"))
    return routed.join(F.broadcast(every)).withColumn("rate", F.col("routed") / F.greatest("sentences", F.lit(1)))  # one row each


@query()
def trigger_facts(spark, d):
    """Facts by trigger words and lexicons, the parts of the body standing for causes."""
    terms = [(p, "Cause") for p in _parts(spark, d)] + [(t, "Symptom") for t in ("钝痛", "跳痛", "刺痒", "发凉", "麻胀")] + [("显影检查", "Examination"), ("松解术", "Treatment"), ("滴剂", "Drug")]
    return extract.trigger_facts(table(spark, d, "documents"), terms)


@query(f"SELECT id, coalesce({sql.case_map(sql.resolve_type('subject_type'), extract.ontology.ENTITY_TYPES)}, subject_type) AS subject_type_label, coalesce({sql.case_map(sql.resolve_relation('relation'), {k: v[0] for k, v in extract.ontology.RELATIONS.items()})}, relation) AS relation_label, coalesce({sql.case_map(sql.resolve_type('object_type'), extract.ontology.ENTITY_TYPES)}, object_type) AS object_type_label FROM triples")
def labelled_facts(spark, d):
    """Labels of types and relations beside every fact."""
    return extract.labelled(table(spark, d, "triples")).select("id", "subject_type_label", "relation_label", "object_type_label")

"""Queries over documents, records, categories and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, scores, text
from ..operators import collect, dedupe, extract, labels, rules, store
from ..runtime import table
from ..streaming import identity
from . import sql

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql_text: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql_text:
            SQL[f.__name__] = sql_text
        return f

    return add


def _d(spark, d):
    return table(spark, d, "documents")


def first_rows(spark, d):
    """The first row of each document_id."""
    docs = _d(spark, d).where("document_id IS NOT NULL")
    return dedupe.first_seen(docs, ("document_id",), "doc_id")


FIRST = "docs1 AS (SELECT * FROM documents WHERE coalesce(document_id,'') <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY doc_id) = 1)"


@query("SELECT doc_id, document_id, category_ids, title, content, source_url, license, collected_at, content_hash, quality_score FROM documents")
def scan_documents(spark, d):
    return _d(spark, d).select("doc_id", "document_id", "category_ids", "title", "content", "source_url", "license", "collected_at", "content_hash", "quality_score")


@query("SELECT 'documents' AS tab, count(*) AS n FROM documents UNION ALL SELECT 'triples', count(*) FROM triples UNION ALL SELECT 'triple_evidence', count(*) FROM triple_evidence UNION ALL SELECT 'records', count(*) FROM records")
def table_counts(spark, d):
    out = None
    for t in ("documents", "triples", "triple_evidence", "records"):
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_CLEAN = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '&[a-zA-Z#0-9]+;', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[{sql._BLANK}]+', ' ', 'g'), {sql.WS})"""


@query(f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_markup(spark, d):
    return _d(spark, d).select("doc_id", text.blank_markup(F.col("text")).alias("cleaned"))


@query()
def clean_text(spark, d):
    return _d(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


_SENT = f"list_filter(list_transform(regexp_extract_all(cleaned, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$'), lambda x: trim(x, {sql.WS})), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_SENT}) AS n, array_to_string({_SENT}, '|') AS joined FROM (SELECT doc_id, {_CLEAN} AS cleaned FROM documents)")
def split_sentences(spark, d):
    s = text.sentences(text.blank_markup(F.col("text")))
    return _d(spark, d).select("doc_id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("joined"))


_TOK = r"'[\x{4e00}-\x{9fff}]+|[a-zA-Z0-9]+(?:[-.][a-zA-Z0-9]+)*|[^\s\x{4e00}-\x{9fff}a-zA-Z0-9]'"


@query(f"SELECT doc_id, len(regexp_extract_all(cleaned, {_TOK})) AS n, array_to_string(regexp_extract_all(cleaned, {_TOK}), ' ') AS tokens FROM (SELECT doc_id, {_CLEAN} AS cleaned FROM documents)")
def tokenize(spark, d):
    t = text.tokens(text.blank_markup(F.col("text")))
    return _d(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


_FIELDS = f"""f AS (SELECT doc_id, coalesce(title,'') AS title, length(cleaned) AS content_length, len({_SENT}) AS sentence_count,
   floor((CASE WHEN length(cleaned) > 0 THEN length(regexp_replace(cleaned, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))::DOUBLE / length(cleaned) ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS cjk_ratio
   FROM (SELECT doc_id, title, {_CLEAN} AS cleaned FROM documents)),
 sc AS (SELECT *, floor(least(greatest((CASE WHEN content_length >= 120 THEN 0.35::DOUBLE WHEN content_length >= 60 THEN 0.20::DOUBLE ELSE 0.05::DOUBLE END) + 0.30::DOUBLE * least(cjk_ratio / 0.9::DOUBLE, 1.0::DOUBLE)
   + (CASE WHEN sentence_count >= 2 THEN 0.20::DOUBLE WHEN sentence_count = 1 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN title <> '' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END), 0.0::DOUBLE), 1.0::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS clean_confidence FROM f),
 lv AS (SELECT *, CASE WHEN clean_confidence >= 0.75 THEN 'high' WHEN clean_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM sc)"""


def _preprocessed(spark, d):
    c = text.blank_markup(F.col("text"))
    f = _d(spark, d).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), c.alias("cleaned"))
    f = f.select("doc_id", "title", F.length("cleaned").cast("long").alias("content_length"), F.size(text.sentences(F.col("cleaned"))).cast("long").alias("sentence_count"), scores.half_up(text.cjk_share(F.col("cleaned")), 4).alias("cjk_ratio"))
    f = f.withColumn("clean_confidence", scores.clean_confidence(F.col("content_length"), F.col("cjk_ratio"), F.col("sentence_count"), F.col("title")))
    return f.withColumn("level", scores.confidence_level(F.col("clean_confidence")))


@query(f"WITH {_FIELDS} SELECT doc_id, content_length, sentence_count, cjk_ratio, clean_confidence, level FROM lv")
def preprocess_documents(spark, d):
    return _preprocessed(spark, d).drop("title")


@query(f"WITH {_FIELDS} SELECT level, count(*) AS n, round(avg(content_length), 3) AS mean_length FROM lv GROUP BY level")
def preprocess_summary(spark, d):
    return _preprocessed(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("content_length"), 3).alias("mean_length"))


@query("SELECT doc_id, floor(least(0.55::DOUBLE + CASE WHEN length(title) >= 2 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN length(content) >= 180 THEN 0.25::DOUBLE WHEN length(content) >= 80 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 0.99::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS quality FROM documents")
def sample_quality(spark, d):
    return _d(spark, d).select("doc_id", scores.sample_quality(F.col("title"), F.col("content")).alias("quality"))


_URL = f"""u AS (SELECT doc_id, {sql.squeeze('source_url')} AS u FROM documents), b AS (SELECT doc_id, u, regexp_replace(u, '#.*$', '') AS b FROM u),
 p AS (SELECT doc_id, u, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(b, '^[^:]+://([^/?]*)', 1)) AS host,
   regexp_extract(b, '^[^:]+://[^/?]*([^?]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT starts_with(lower(string_split(q, '=')[1]), 'utm_')
   AND lower(string_split(q, '=')[1]) NOT IN {sql.names(ids.TRACKING_KEYS)})) AS qs FROM b)"""


@query(f"""WITH {_URL} SELECT doc_id, CASE WHEN scheme IN ('http','https') THEN scheme || '://' || host || CASE WHEN path IN ('','/') THEN '/' ELSE regexp_replace(path, '/+$', '') END
  || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(list_transform(qs, lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END), '&') ELSE '' END ELSE u END AS url FROM p""")
def canonical_url(spark, d):
    return _d(spark, d).select("doc_id", ids.canonical_url(F.col("source_url")).alias("url"))


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(content,'')) AS hash FROM documents")
def content_hashes(spark, d):
    return _d(spark, d).select("doc_id", ids.text_hash(F.coalesce("content", F.lit(""))).alias("hash"))


@query("SELECT run_id, document_id, 'doc_' || left(sha256(coalesce(source_name,'') || chr(0) || coalesce(source_record_id,'')), 24) AS stable_id FROM records")
def stable_ids(spark, d):
    return table(spark, d, "records").select("run_id", "document_id", ids.document_id(F.coalesce("source_name", F.lit("")), F.coalesce("source_record_id", F.lit(""))).alias("stable_id"))


@query("SELECT doc_id, array_to_string(CASE WHEN trim(coalesce(category_ids,'')) = '' THEN [] WHEN regexp_matches(category_ids, '^\\s*\\[') THEN from_json(replace(category_ids, '''', '\"'), '[\"VARCHAR\"]') ELSE [trim(category_ids)] END, '|') AS categories FROM documents")
def category_lists(spark, d):
    # lists written with single quotes are read as well
    return _d(spark, d).select("doc_id", F.array_join(collect.category_list(F.when(F.col("category_ids").rlike("^\\s*\\["), F.translate("category_ids", "'", '"')).otherwise(F.col("category_ids"))), "|").alias("categories"))


@query("SELECT doc_id, title FROM documents WHERE regexp_matches(coalesce(title,''), '转载|综述|问答')")
def offtopic_titles(spark, d):
    return rules.off_topic(_d(spark, d), "转载|综述|问答").select("doc_id", "title")


@query("SELECT id FROM triples WHERE source_document_id IS NULL OR source_document_id NOT IN (SELECT document_id FROM documents WHERE document_id IS NOT NULL AND regexp_matches(coalesce(title,''), '转载|综述|问答'))")
def purge_triples(spark, d):
    return rules.purge(table(spark, d, "triples"), rules.off_topic(_d(spark, d), "转载|综述|问答"), ("source_document_id",)).select("id")


_OFF = "(SELECT document_id FROM documents WHERE document_id IS NOT NULL AND regexp_matches(coalesce(title,''), '转载|综述|问答'))"


@query(f"SELECT 'documents' AS tab, count(*) AS kept FROM documents WHERE document_id IS NULL OR document_id NOT IN {_OFF} UNION ALL SELECT 'extract_state', count(*) FROM extract_state WHERE document_id NOT IN {_OFF} UNION ALL SELECT 'triple_evidence', count(*) FROM triple_evidence WHERE source_document_id IS NULL OR source_document_id NOT IN {_OFF} UNION ALL SELECT 'triples', count(*) FROM triples WHERE source_document_id IS NULL OR source_document_id NOT IN {_OFF}")
def purge_tables(spark, d):
    """All four tables without the off-topic documents and what hangs on them."""
    off = rules.off_topic(_d(spark, d), "转载|综述|问答")
    out = None
    for name, key in (("documents", "document_id"), ("extract_state", "document_id"), ("triple_evidence", "source_document_id"), ("triples", "source_document_id")):
        one = rules.purge(table(spark, d, name), off, (key,)).agg(F.count("*").alias("kept")).select(F.lit(name).alias("tab"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id, title FROM documents WHERE length({sql.s('title')}) BETWEEN 2 AND 20 AND {sql.ends(sql.s('title'), text.DISEASE_ENDS)}")
def disease_titles(spark, d):
    return _d(spark, d).where(text.is_disease_title(F.col("title"))).select("doc_id", "title")


@query("SELECT DISTINCT title FROM documents WHERE NOT regexp_matches(title, '[\\x{4e00}-\\x{9fff}]') AND regexp_matches(title, '\\p{L}')")
def latin_names(spark, d):
    return _d(spark, d).where(text.is_latin_word(F.col("title"))).select("title").distinct()


@query("SELECT DISTINCT object, object_type, CASE object_type " + " ".join(f"WHEN '{k}' THEN coalesce({sql.ends('object', v)}, false)" for k, v in text.TYPE_ENDS.items()) + " ELSE true END AS plausible FROM triples")
def plausible_entities(spark, d):
    return table(spark, d, "triples").select("object", "object_type", text.plausible(F.col("object"), F.col("object_type")).alias("plausible")).distinct()


_KNOWN = {"Drug": ["Dawito 片", "Zévuvo 滴剂"], "Treatment": ["胥糜边式皮层松解术"], "Examination": []}


@query("SELECT DISTINCT object, object_type, CASE object_type " + " ".join(f"WHEN '{k}' THEN coalesce({sql.ends('object', v)}{' OR object IN ' + sql.names(_KNOWN[k]) if _KNOWN[k] else ''}, false)" for k, v in text.TYPE_ENDS.items()) + " ELSE true END AS plausible FROM triples")
def plausible_by_lexicon(spark, d):
    return table(spark, d, "triples").select("object", "object_type", text.plausible(F.col("object"), F.col("object_type"), _KNOWN).alias("plausible")).distinct()


@query(f"SELECT DISTINCT object, CASE WHEN trim(object, {sql.WS}) = '' OR regexp_matches(trim(object, {sql.WS}), '[{text.TEMPLATE_NOISE}]') THEN NULL ELSE trim(object, {sql.WS}) END AS term FROM triples")
def template_noise(spark, d):
    return table(spark, d, "triples").select("object", text.template_term(F.col("object")).alias("term")).distinct()


_PLAIN = "translate(coalesce({0},''), '" + text.IGNORED_IN_EVIDENCE.replace("'", "''") + "', '')"


@query(f"""SELECT t.id, contains({_PLAIN.format('d.content')}, {_PLAIN.format('t.source_text')}) AND {_PLAIN.format('t.source_text')} <> '' AS found FROM triples t JOIN (SELECT * FROM documents WHERE coalesce(document_id,'') <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY doc_id) = 1) d ON d.document_id = t.source_document_id""")
def evidence_contained(spark, d):
    docs = first_rows(spark, d).select(F.col("document_id").alias("k"), "content")
    t = table(spark, d, "triples").join(docs, F.col("source_document_id") == F.col("k"))
    drop = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), text.IGNORED_IN_EVIDENCE, "")
    return t.select("id", (F.contains(drop("content"), drop("source_text")) & (drop("source_text") != "")).alias("found"))


_DROP = "translate(coalesce({0}, ''), '" + text.IGNORED_IN_EVIDENCE.replace("'", "''") + "', '')"


@query(f"""WITH {FIRST}, x AS (SELECT t.id, {_DROP.format('t.source_text')} AS ev, {_DROP.format('d.content')} AS ct FROM triples t JOIN docs1 d ON d.document_id = t.source_document_id),
  y AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(ev) - 1, 1) + 1), lambda i: substring(ev, i, 2))) AS own FROM x)
  SELECT id, CASE WHEN ev = '' THEN false ELSE contains(ct, ev) OR 2 * len(list_filter(own, lambda g: contains(ct, g))) >= len(own) END AS supported FROM y""")
def evidence_supported(spark, d):
    docs = first_rows(spark, d).select(F.col("document_id").alias("k"), "content")
    t = table(spark, d, "triples").join(docs, F.col("source_document_id") == F.col("k"))
    return t.select("id", text.supported(F.col("source_text"), F.col("content")).alias("supported"))


_STATE = "NOT EXISTS (SELECT 1 FROM extract_state s WHERE s.document_id = d.document_id AND s.content_hash = d.content_hash)"


@query(f"SELECT doc_id, document_id FROM documents d WHERE {_STATE}")
def incremental_documents(spark, d):
    return store.changed(_d(spark, d), table(spark, d, "extract_state")).select("doc_id", "document_id")


@query(f"WITH {FIRST} SELECT document_id, content_hash FROM docs1 d WHERE coalesce(content_hash,'') <> '' AND document_id IN (SELECT source_document_id FROM triples) AND document_id NOT IN (SELECT document_id FROM extract_state)")
def seed_state(spark, d):
    return store.seed_state(table(spark, d, "triples"), first_rows(spark, d), table(spark, d, "extract_state"))


_NINE = ("document_id", "category_ids", "title", "content", "source_url", "license", "collected_at", "content_hash", "quality_score")
_BATCH = f"""{FIRST}, s AS (SELECT json_extract_string(canonical_json, '$.document_id') AS document_id, '[' || coalesce(array_to_string(list_transform(json_extract_string(canonical_json, '$.classifications[*].category_id'), lambda c: '"' || c || '"'), ', '), '') || ']' AS category_ids,
  json_extract_string(canonical_json, '$.bibliography.title') AS title, json_extract_string(canonical_json, '$.text.content') AS content, coalesce(json_extract_string(canonical_json, '$.source.url'), '') AS source_url, coalesce(json_extract_string(canonical_json, '$.source.rights_statement'), 'unknown') AS license,
  coalesce(json_extract_string(canonical_json, '$.provenance[0].collected_at'), '') AS collected_at, json_extract_string(canonical_json, '$.text.content_hash') AS content_hash, CAST(json_extract_string(canonical_json, '$.quality.score') AS DOUBLE) AS quality_score
  FROM records WHERE coalesce(json_extract_string(canonical_json, '$.document_id'), '') <> '' QUALIFY row_number() OVER (PARTITION BY json_extract_string(canonical_json, '$.document_id') ORDER BY created_at, run_id) = 1)"""


def _batch(spark, d):
    return first_rows(spark, d).select(*_NINE), collect.legacy_rows(table(spark, d, "records"))


@query(f"WITH {_BATCH} SELECT coalesce(t.document_id, s.document_id) AS document_id, CASE WHEN t.document_id IS NOT NULL THEN t.category_ids ELSE s.category_ids END AS category_ids, " + ", ".join(f"CASE WHEN s.document_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _NINE[2:]) + " FROM docs1 t FULL JOIN s ON s.document_id = t.document_id")
def import_records(spark, d):
    """All records into all documents: seven columns are updated, old categories stay."""
    t, s = _batch(spark, d)
    return store.upsert(t, s, "document_id", list(_NINE[2:]))


@query(f"WITH {_BATCH} SELECT {', '.join(_NINE)} FROM docs1 UNION ALL SELECT {', '.join(_NINE)} FROM s WHERE document_id NOT IN (SELECT document_id FROM docs1)")
def import_missing_records(spark, d):
    t, s = _batch(spark, d)
    return store.insert_missing(t, s, "document_id")


@query(f"WITH {_BATCH} SELECT coalesce(s.document_id, t.document_id) AS document_id, " + ", ".join(f"CASE WHEN s.document_id IS NOT NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in _NINE[1:]) + " FROM docs1 t FULL JOIN s ON s.document_id = t.document_id")
def merge_records(spark, d):
    t, s = _batch(spark, d)
    return store.merge_reports(s, t)


_CODE = f"upper(trim({sql.squeeze('clc_code')}, '[]{{}}'))"
_FLAG = "CASE WHEN lower({0}) IN ('1','true','yes','y') THEN true WHEN lower({0}) IN ('0','false','no','n') THEN false END"


@query(f"SELECT category_id, {_CODE} AS clc_code, target_count, {_FLAG.format(sql.squeeze('enabled'))} AS enabled, {_FLAG.format(sql.squeeze('reviewed'))} AS reviewed FROM clc_r_categories")
def catalog_scan(spark, d):
    return collect.catalog(table(spark, d, "clc_r_categories")).select("category_id", "clc_code", "target_count", "enabled", "reviewed")


@query(f"SELECT category_id, term FROM (SELECT category_id, {sql.squeeze('x')} AS term FROM (SELECT category_id, unnest(string_split(query_terms, '|')) AS x FROM clc_r_categories WHERE lower(trim(enabled)) = 'true' AND lower(trim(reviewed)) = 'true')) WHERE term <> ''")
def catalog_queries(spark, d):
    return collect.catalog_terms(table(spark, d, "clc_r_categories")).select("category_id", "term")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE {_FLAG.format(sql.squeeze('enabled'))}) AS enabled, count(*) FILTER (WHERE {_FLAG.format(sql.squeeze('reviewed'))}) AS reviewed FROM clc_r_categories")
def catalog_counts(spark, d):
    return collect.catalog(table(spark, d, "clc_r_categories")).agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if("reviewed").alias("reviewed"))


_KEYC = f"regexp_replace({_CODE}, '[^A-Z0-9]', '', 'g')"


@query(f"WITH k AS (SELECT category_id, {_KEYC} AS key, regexp_replace(upper(coalesce(parent_code,'')), '[^A-Z0-9]', '', 'g') AS parent FROM clc_r_categories) SELECT category_id, parent <> '' AND key <> '' AND (starts_with(key, parent) OR starts_with(parent, key)) AS compatible FROM k")
def code_prefix(spark, d):
    return table(spark, d, "clc_r_categories").select("category_id", collect.code_compatible(F.coalesce("parent_code", F.lit("")), F.col("clc_code")).alias("compatible"))


@query(f"WITH k AS (SELECT category_id, {_CODE} AS code, 'CLC=' || {_CODE} || ' OR CLC=' || coalesce(parent_code, '') || '.1' AS q FROM clc_r_categories) SELECT category_id, regexp_matches(' ' || upper(q) || ' ', '[^A-Z0-9.]' || regexp_escape(code) || '[^A-Z0-9.]') AS declared FROM k")
def code_token(spark, d):
    c = table(spark, d, "clc_r_categories")
    q = F.concat(F.lit("CLC="), ids.class_code(F.col("clc_code")), F.lit(" OR CLC="), F.coalesce("parent_code", F.lit("")), F.lit(".1"))
    return c.select("category_id", ids.declares_code(q, F.col("clc_code")).alias("declared"))


_REC = """r AS (SELECT run_id, document_id, source_name, source_record_id, content_hash, created_at, json_extract_string(canonical_json, '$.document_id') AS jid, json_extract_string(canonical_json, '$.bibliography.title') AS title,
  json_extract_string(canonical_json, '$.text.content') AS content, json_extract_string(canonical_json, '$.source.url') AS url, json_extract_string(canonical_json, '$.source.name') AS sname, json_extract_string(canonical_json, '$.source.record_id') AS srid,
  json_extract_string(canonical_json, '$.schema_version') AS version, json_extract_string(canonical_json, '$.text.content_hash') AS jhash, json_extract_string(canonical_json, '$.classifications[*].category_id') AS cats, CAST(json_extract_string(canonical_json, '$.quality.score') AS DOUBLE) AS score FROM records)"""


@query(f"WITH {_REC} SELECT run_id, document_id, jid AS doc, title, array_to_string(cats, '|') AS category_ids, url AS source_url, score AS quality_score FROM r")
def legacy_projection(spark, d):
    r = collect.parsed(table(spark, d, "records"))
    return r.select("run_id", "document_id", F.col("doc.document_id").alias("doc"), F.col("doc.bibliography.title").alias("title"), F.array_join("doc.classifications.category_id", "|").alias("category_ids"), F.col("doc.source.url").alias("source_url"), F.col("doc.quality.score").alias("quality_score"))


_CC = f"{_REC}, n AS (SELECT cat, count(DISTINCT jid) AS n FROM (SELECT jid, unnest(cats) AS cat FROM r) GROUP BY cat), cc AS (SELECT c.category_id, coalesce(n.n, 0) AS documents, coalesce({_FLAG.format(sql.squeeze('c.reviewed'))}, false) AS reviewed FROM clc_r_categories c LEFT JOIN n ON n.cat = c.category_id)"


@query(f"WITH {_CC} SELECT category_id, documents FROM cc")
def category_counts(spark, d):
    return collect.category_counts(table(spark, d, "records"), table(spark, d, "clc_r_categories"))


@query(f"WITH {_CC} SELECT count(*) FILTER (WHERE documents >= 3 AND reviewed) AS reviewed_categories, count(*) FILTER (WHERE documents < 3) AS shortfalls, count(*) FILTER (WHERE NOT reviewed AND documents > 0) AS unreviewed_with_documents, (SELECT count(DISTINCT jid) FROM r) AS unique_documents, count(*) FILTER (WHERE documents >= 3 AND reviewed) >= 10 AND (SELECT count(DISTINCT jid) FROM r) >= 50 AS passed FROM cc")
def audit_gates(spark, d):
    recs = table(spark, d, "records")
    cats = collect.catalog(table(spark, d, "clc_r_categories")).withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    ids_ = collect.parsed(recs).select(F.col("doc.document_id").alias("document_id"))
    return collect.audit(collect.category_counts(recs, cats), cats, 10, 50, 3, ids_)


@query("SELECT run_id, count(*) AS seen, count(DISTINCT document_id) AS documents, count(*) FILTER (WHERE updated_at IS NULL) AS never_updated FROM records GROUP BY run_id")
def run_metrics(spark, d):
    return table(spark, d, "records").groupBy("run_id").agg(F.count("*").alias("seen"), F.count_distinct("document_id").alias("documents"), F.count_if(F.col("updated_at").isNull()).alias("never_updated"))


@query("""WITH c AS (SELECT run_id, unnest(json_extract_string(canonical_json, '$.classifications[*].category_id')) AS cat, unnest(json_extract_string(canonical_json, '$.classifications[*].verified')) AS v, document_id FROM records)
  SELECT run_id, count(DISTINCT cat) AS categories, count(*) FILTER (WHERE v = 'true') AS verified, count(*) FILTER (WHERE v IS DISTINCT FROM 'true') AS unverified FROM c GROUP BY run_id""")
def run_assignments(spark, d):
    """Per run its categories, and its verified and unverified assignments."""
    c = collect.parsed(table(spark, d, "records")).select("run_id", F.explode("doc.classifications").alias("c"))
    ok = F.coalesce(F.col("c.verified"), F.lit(False))
    return c.groupBy("run_id").agg(F.count_distinct("c.category_id").alias("categories"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("unverified"))


@query()
def identity_keys(spark, d):
    return collect.identity_keys(table(spark, d, "records")).select("run_id", "document_id", F.array_join("keys", " ").alias("keys"))


_PART = "regexp_replace(clc_name, '(保健|病学|康复|药理|检验)$', '')"


@query(f"WITH p AS (SELECT DISTINCT {_PART} AS part FROM clc_r_categories) SELECT d.doc_id, p.part AS term FROM documents d JOIN p ON contains({sql.squeeze('d.title')}, p.part)")
def term_contains(spark, d):
    parts = table(spark, d, "clc_r_categories").select(F.regexp_replace("clc_name", "(保健|病学|康复|药理|检验)$", "").alias("p")).distinct()
    terms = [(r.p, "Part") for r in parts.collect()]  # bounded by the fixed table of categories
    s = _d(spark, d).select("doc_id", F.lit(0).alias("pos"), text.squeeze(F.col("title")).alias("sentence"))
    return extract.contained_terms(s, terms).select("doc_id", "term")


@query(f"""WITH p AS (SELECT DISTINCT {_PART} AS part FROM clc_r_categories), c AS (SELECT doc_id, {_CLEAN.replace("coalesce(text,'')", "coalesce(content,'')")} AS cleaned FROM documents), l AS (SELECT doc_id, {_SENT} AS s FROM c),
  u AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM l) SELECT doc_id, min(pos)::INT AS pos, part AS term FROM u JOIN p ON contains(sentence, part) GROUP BY doc_id, part""")
def first_sentences(spark, d):
    parts = table(spark, d, "clc_r_categories").select(F.regexp_replace("clc_name", "(保健|病学|康复|药理|检验)$", "").alias("p")).distinct()
    terms = [(r.p, "Part") for r in parts.collect()]
    return extract.first_sentences(extract.contained_terms(extract.sentence_rows(_d(spark, d)), terms)).select("doc_id", "pos", "term")


@query()
def rule_layer_facts(spark, d):
    terms = [(t, k) for k, ts in extract.LEXICON.items() for t in ts]
    return extract.rule_facts(_d(spark, d), terms).select("doc_id", "subject", "relation", "object", "object_type", "confidence")


@query()
def span_facts(spark, d):
    """Spans of the lexicon tagger, paired by clause, sentence or title."""
    docs = _d(spark, d)
    spans = extract.tag_spans(extract.sentence_rows(docs), extract.lexicon_tagger())
    return extract.pair_spans(spans, titles=docs.select("doc_id", "title")).select("doc_id", "pos", "subject", "relation", "object", "object_type", "confidence")


@query()
def bio_labels(spark, d):
    parts = table(spark, d, "clc_r_categories").select(F.regexp_replace("clc_name", "(保健|病学|康复|药理|检验)$", "").alias("p")).distinct()
    terms = [(r.p, "Part") for r in parts.collect()]
    lab = labels.label_sentences(extract.sentence_rows(_d(spark, d)), terms)
    return lab.select("doc_id", "pos", F.array_join("labels", " ").alias("labels"), F.size(labels.spans_of(F.col("labels"))).alias("spans"))


@query()
def weak_dataset(spark, d):
    """Weakly labelled sentences of whole texts: parts of the body, and the kinds of findings."""
    parts = table(spark, d, "clc_r_categories").select(F.regexp_replace("clc_name", "(保健|病学|康复|药理|检验)$", "").alias("p")).distinct()
    # bounded by the fixed table of categories
    terms = [(r.p, "Part") for r in parts.collect()] + [(t, "Symptom") for t in ("钝痛", "跳痛", "刺痒", "发凉", "麻胀")]
    lab = labels.weak_dataset(extract.sentence_rows(_d(spark, d), content="text"), terms)
    return lab.select("doc_id", "pos", F.array_join("labels", " ").alias("labels"))


def _kept(spark, d):
    return table(spark, d, "triples").where("confidence >= 0.8")


@query()
def review_bio(spark, d):
    """Training sentences of the facts that a reviewer keeps (here: those of high confidence)."""
    return labels.review_dataset(_kept(spark, d)).select("sentence", F.array_join("labels", " ").alias("labels"), F.array_join("source_ids", ",").alias("source_ids")).orderBy("sentence")


_LEARNED = sql.names(labels.SPAN_TYPES)


@query(f"""WITH r AS (SELECT CASE WHEN NOT coalesce(subject_type IN {_LEARNED} AND object_type IN {_LEARNED}, false) THEN coalesce(subject_type, '?') || '/' || coalesce(object_type, '?')
  WHEN coalesce(trim(source_text), '') = '' THEN 'no evidence' END AS reason FROM triples WHERE confidence >= 0.8) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def review_skips(spark, d):
    return labels.review_skips(_kept(spark, d))


@query()
def label_histogram(spark, d):
    return labels.label_histogram(labels.review_dataset(_kept(spark, d)))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


@query("SELECT vec_id, round(1.0 / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))), 6) AS p FROM embeddings")
def softmax_top(spark, d):
    top = F.array_max("embedding").cast("double")
    z = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    return table(spark, d, "embeddings").select("vec_id", F.round(1.0 / z, 6).alias("p"))


@query("SELECT user_id, event_type, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def job_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("user_id", "event_type", "event_id")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_status, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY user_id")
def event_states(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 40 OFFSET 40")
def page_slice(spark, d):
    return _d(spark, d).orderBy("doc_id").offset(40).limit(40).select("doc_id", "title")


@query("""WITH c AS (SELECT json_extract_string(canonical_json, '$.document_id') AS jid, unnest(json_extract_string(canonical_json, '$.classifications[*].category_id')) AS cat, source_name || '/' || run_id AS basis, CAST(json_extract_string(canonical_json, '$.quality.score') AS DOUBLE) AS score, epoch_us(created_at) AS pos, run_id AS code FROM records),
  k AS (SELECT jid, cat, code, min(pos) AS first FROM c GROUP BY ALL), kk AS (SELECT jid, cat, string_agg(code, '|' ORDER BY first, code) AS codes FROM k GROUP BY ALL)
  SELECT c.jid AS document_id, c.cat AS category_id, arg_max(basis, (coalesce(score >= 0.9, false), coalesce(score, 0), -pos)) AS basis, bool_or(coalesce(score >= 0.9, false)) AS verified, max(coalesce(score, 0)) AS confidence, any_value(codes) AS codes FROM c JOIN kk ON kk.jid = c.jid AND kk.cat = c.cat GROUP BY c.jid, c.cat""")
def merge_classifications(spark, d):
    """Classes of a document's records in the order of their arrival."""
    r = collect.parsed(table(spark, d, "records")).select(
        F.col("doc.document_id").alias("document_id"), F.explode("doc.classifications.category_id").alias("category_id"), F.coalesce(F.col("doc.quality.score") >= 0.9, F.lit(False)).alias("verified"),
        F.col("doc.quality.score").alias("confidence"), F.concat_ws("/", "source_name", "run_id").alias("basis"), F.col("run_id").alias("code"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("pos"),
    )
    return dedupe.merge_classifications(r.where("document_id IS NOT NULL AND category_id IS NOT NULL"))


@query("SELECT DISTINCT json_extract_string(canonical_json, '$.document_id') AS document_id, content_hash, run_id, source_record_id FROM records")
def merge_provenance(spark, d):
    r = table(spark, d, "records")
    return r.select(F.get_json_object("canonical_json", "$.document_id").alias("document_id"), "content_hash", "run_id", "source_record_id").distinct()


@query("SELECT source_text AS sentence FROM triples WHERE source_text IS NOT NULL UNION ALL SELECT DISTINCT source_text FROM triple_evidence WHERE source_text IS NOT NULL AND source_text NOT IN (SELECT source_text FROM triples WHERE source_text IS NOT NULL)")
def unseen_append(spark, d):
    s = lambda t: table(spark, d, t).where("source_text IS NOT NULL").select(F.col("source_text").alias("sentence"))
    return labels.append_unseen(s("triples"), s("triple_evidence"))


@query("SELECT layer AS part, source_text AS sentence FROM triples WHERE layer = 'rule' UNION ALL SELECT 'evidence', source_text FROM triple_evidence")
def training_union(spark, d):
    a = table(spark, d, "triples").where("layer = 'rule'").select(F.col("layer").alias("part"), F.col("source_text").alias("sentence"))
    b = table(spark, d, "triple_evidence").select(F.lit("evidence").alias("part"), F.col("source_text").alias("sentence"))
    return a.unionByName(b, allowMissingColumns=True)


_PR = """p AS (SELECT source_document_id AS doc, list(DISTINCT subject || '|' || object) FILTER (WHERE layer = 'llm' AND subject IS NOT NULL AND object IS NOT NULL) AS gold, list(DISTINCT subject || '|' || object) FILTER (WHERE layer = 'rule' AND confidence >= {0} AND subject IS NOT NULL AND object IS NOT NULL) AS found FROM triples WHERE source_document_id IS NOT NULL GROUP BY 1),
 q AS (SELECT sum(len(list_intersect(coalesce(gold, []), coalesce(found, [])))) AS tp, sum(len(coalesce(found, []))) AS nf, sum(len(coalesce(gold, []))) AS ng FROM p)"""


def _span_pairs(spark, d, threshold):
    t = table(spark, d, "triples").where("source_document_id IS NOT NULL")
    key = F.concat_ws("|", "subject", "object")
    whole = F.col("subject").isNotNull() & F.col("object").isNotNull()
    return t.groupBy("source_document_id").agg(F.collect_set(F.when(whole & (F.col("layer") == "llm"), key)).alias("gold"), F.collect_set(F.when(whole & (F.col("layer") == "rule") & (F.col("confidence") >= threshold), key)).alias("found"))


@query(f"WITH {_PR.format(0.0)} SELECT CAST(tp AS BIGINT) AS tp, CAST(nf - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, round(coalesce(tp::DOUBLE / nullif(nf, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(ng, 0), 0), 6) AS recall FROM q")
def span_prf(spark, d):
    return labels.precision_recall(_span_pairs(spark, d, 0.0)).select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_GRID = [(m, c) for m in (1, 2) for c in (0.5, 0.6, 0.7, 0.8)]
_GOOD = "length(object) >= {0} AND confidence >= {1}"
_SPANS = """s AS (SELECT source_document_id AS doc, id, subject || '|' || object AS span, layer, confidence, object FROM triples WHERE source_document_id IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL),
 g AS (SELECT doc, list(DISTINCT span) FILTER (WHERE layer = 'llm') AS gold FROM s GROUP BY doc)"""


@query(" UNION ALL ".join(f"""(WITH {_SPANS}, f AS (SELECT doc, list(DISTINCT span) FILTER (WHERE {_GOOD.format(m, c)}) AS found, count(*) FILTER (WHERE {_GOOD.format(m, c)}) AS kept, bool_or(NOT coalesce({_GOOD.format(m, c)}, false)) AS unsure FROM s WHERE layer = 'rule' GROUP BY doc),
  j AS (SELECT coalesce(gold, []) AS gold, coalesce(found, []) AS found, coalesce(kept, 0) AS kept, coalesce(unsure, false) AS unsure FROM g LEFT JOIN f USING (doc))
  SELECT {m} AS min_len, {c}::DOUBLE AS threshold, sum(len(list_intersect(gold, found)))::BIGINT AS tp, sum(len(found) - len(list_intersect(gold, found)))::BIGINT AS fp, sum(len(gold) - len(list_intersect(gold, found)))::BIGINT AS fn, sum(kept)::BIGINT AS kept,
   round(count(*) FILTER (WHERE unsure AND len(gold) > 0) / greatest(sum(len(gold)), 1), 6) AS routed FROM j)""" for m, c in _GRID))
def threshold_grid(spark, d):
    """Facts of the rule layer against those of the llm layer per document, at every least length and confidence."""
    t = table(spark, d, "triples").where("source_document_id IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL")
    span = F.concat_ws("|", "subject", "object")
    found = F.struct(span.alias("span"), F.length("object").alias("size"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))
    docs = t.groupBy("source_document_id").agg(F.collect_set(F.when(F.col("layer") == "llm", span)).alias("gold"), F.collect_list(F.when(F.col("layer") == "rule", found)).alias("spans"))
    return labels.threshold_grid(docs, (1, 2), (0.5, 0.6, 0.7, 0.8)).select("min_len", "threshold", "tp", "fp", "fn", "kept", F.round("routed", 6).alias("routed"))


@query()
def hash_split(spark, d):
    return labels.hash_split(_d(spark, d), "doc_id").groupBy("part").agg(F.count("*").alias("n"))


@query()
def hash_sample(spark, d):
    return _d(spark, d).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(50).select("doc_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def orders_keep_best(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n.n_name AS nation, r.r_name AS region, count(o.o_orderkey) AS orders FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2")
def zero_fill(spark, d):
    n, r, c, o = (table(spark, d, x) for x in ("nation", "region", "customer", "orders"))
    per = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("orders"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(per, n["n_nationkey"] == per["c_nationkey"], "left").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1, 2")
def lineitem_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))


@query(f"WITH t AS (SELECT category_id, unnest(string_split(query_terms, '|')) AS x FROM clc_r_categories), k AS (SELECT category_id, lower({sql.squeeze('x')}) AS term FROM t), {_REC}, d AS (SELECT run_id, document_id, lower({sql.squeeze('content')}) AS body, unnest(cats) AS cat FROM r) SELECT run_id, document_id, cat AS category_id, bool_or(term <> '' AND contains(body, term)) AS matched FROM d JOIN k ON k.category_id = d.cat GROUP BY 1, 2, 3")
def query_term_match(spark, d):
    raw = table(spark, d, "clc_r_categories").select(F.col("category_id").alias("k"), F.explode(F.split("query_terms", "\\|")).alias("term"))
    r = collect.parsed(table(spark, d, "records")).select("run_id", "document_id", F.lower(text.squeeze(F.col("doc.text.content"))).alias("body"), F.explode("doc.classifications.category_id").alias("category_id"))
    return r.join(raw, F.col("category_id") == F.col("k")).groupBy("run_id", "document_id", "category_id").agg(F.bool_or(collect.term_matches(F.col("term"), F.col("body"), False)).alias("matched"))


@query(f"SELECT category_id FROM clc_r_categories WHERE category_id IN ('clc_r132', 'clc_r999') OR {_CODE} IN ('R155', 'R200')")
def category_select(spark, d):
    c = table(spark, d, "clc_r_categories")
    return c.where(F.col("category_id").isin("clc_r132", "clc_r999") | ids.class_code(F.col("clc_code")).isin("R155", "R200")).select("category_id")


@query("SELECT category_id, 'sha256:' || sha256(CAST(to_json({'category_id': category_id, 'clc_code': clc_code, 'clc_name': clc_name}) AS VARCHAR)) AS fingerprint FROM clc_r_categories")
def row_fingerprints(spark, d):
    c = table(spark, d, "clc_r_categories")
    return c.select("category_id", ids.fingerprint({k: F.col(k) for k in ("clc_name", "category_id", "clc_code")}).alias("fingerprint"))


@query(f"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(coalesce(title,''), '[{text.CLAUSE_MARKS}]'), lambda x: trim(x, {sql.WS})), lambda x: x <> '')) AS n,
  array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(title,''), '[{text.CLAUSE_MARKS}]'), lambda x: trim(x, {sql.WS})), lambda x: x <> ''), '|') AS clauses FROM documents""")
def split_clauses(spark, d):
    c = text.clauses(F.coalesce("title", F.lit("")))
    return _d(spark, d).select("doc_id", F.size(c).cast("long").alias("n"), F.array_join(F.transform(c, lambda x: x["text"]), "|").alias("clauses"))


@query("""SELECT doc_id, CASE WHEN length(coalesce(title,'')) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(title) - 1, 1) + 1), lambda i: substring(title, i, 2)))) END AS n,
  CASE WHEN length(coalesce(title,'')) = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length(title) - 1, 1) + 1), lambda i: substring(title, i, 2)))), '|') END AS pairs FROM documents""")
def title_bigrams(spark, d):
    b = text.bigrams(F.coalesce("title", F.lit("")))
    return _d(spark, d).select("doc_id", F.size(b).cast("long").alias("n"), F.array_join(F.array_sort(b), "|").alias("pairs"))


@query("SELECT part, count(*) AS n FROM (SELECT 'new' AS part, document_id, content_hash, CAST(NULL AS INT) AS triple_count FROM documents UNION ALL SELECT 'state', document_id, content_hash, triple_count FROM extract_state) GROUP BY part")
def schema_merge(spark, d):
    a = _d(spark, d).select(F.lit("new").alias("part"), "document_id", "content_hash")
    return a.unionByName(table(spark, d, "extract_state").withColumn("part", F.lit("state")), allowMissingColumns=True).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT layer, array_to_string(list(id ORDER BY id)[1:5], ',') AS first_ids FROM triples GROUP BY layer")
def first_ids_per_layer(spark, d):
    best = dedupe.capped(table(spark, d, "triples").withColumn("g", F.coalesce("layer", F.lit("\x00"))), "g", "id", 5)
    return best.groupBy("layer").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))


@query()
def identity_dispositions(spark, d):
    keys = collect.identity_keys(table(spark, d, "records")).withColumnRenamed("run_id", "r").withColumnRenamed("document_id", "i")
    rec = table(spark, d, "records").select("run_id", "document_id", "source_name", "content_hash")
    rows = rec.join(keys, (F.col("run_id") == F.col("r")) & (F.col("document_id") == F.col("i"))).select("source_name", "document_id", "content_hash", "keys", "run_id")
    return identity.resolve_batch(rows, "run_id")

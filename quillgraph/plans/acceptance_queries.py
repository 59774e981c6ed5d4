"""Queries over candidates and canonical documents, their acceptance and validation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import acceptance
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


MIN_CHARS = 150
# The tables' sources in the roles of the searched and the exported one.
ROLES = {"wiki_mirror": acceptance.SEARCHED, "journal_export": acceptance.EXPORTED}


def candidates(spark, d):
    """Every document as a candidate for the first category it names; further ones give the codes of its source."""
    cats = table(spark, d, "clc_r_categories").select("category_id", "clc_code", F.filter(F.transform(F.split("query_terms", "\\|"), text.squeeze), lambda t: t != "").alias("terms"))
    found = F.regexp_extract_all("category_ids", F.lit("clc_r[0-9]+"), F.lit(0))
    docs = table(spark, d, "documents").withColumn("named", found)
    first = cats.select(F.col("category_id").alias("_first"), "clc_code", "terms")
    other = cats.select(F.col("category_id").alias("_other"), F.col("clc_code").alias("_code"))
    docs = docs.join(first, F.get("named", F.lit(0)) == F.col("_first")).join(other, F.get("named", F.lit(1)) == F.col("_other"), "left")
    role = F.col("source")
    for name, as_ in ROLES.items():
        role = F.when(F.col("source") == name, as_).otherwise(role)
    none = F.array().cast("array<string>")
    return docs.select(
        "doc_id", "title", F.lit(None).cast("string").alias("abstract"), "content", none.alias("keywords"), F.array(F.col("source_url")).alias("snippets"), role.alias("source_name"),
        F.col("document_id").alias("source_record_id"), F.col("license").alias("access_basis"), F.concat(F.lit("CLC="), "clc_code").alias("query_text"),
        F.when(F.col("_code").isNotNull(), F.array("_code")).alias("source_codes"), F.floor(F.col("n_chars") / 10).cast("int").alias("search_rank"), F.col("lang").eqNullSafe("en").alias("has_authors"),
        "clc_code", "terms",
    )


_CODE = "upper(trim({0}, '[]{{}}'))"
_STEM = "lower(x)"
for _f in ("系统疾病", "性疾病", "疾病", "医学", "科学", "学科", "疗法", "治疗", "诊断", "检查"):
    _STEM = f"replace({_STEM}, '{_f}', '')"
_STEM = f"regexp_replace({_STEM}, '学$', '')"
_KEY = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"
_ROLE = "CASE source " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items()) + " ELSE source END"
JUDGED = f"""
c0 AS (SELECT doc_id, {sql.squeeze('title')} AS title, {sql.squeeze('content')} AS content, {_ROLE} AS source, document_id, license, source_url, n_chars, lang, regexp_extract_all(category_ids, 'clc_r[0-9]+') AS named FROM documents),
c1 AS (SELECT c0.*, a.clc_code AS raw_code, a.query_terms, {_CODE.format(sql.squeeze('b.clc_code'))} AS other_code, b.clc_code IS NOT NULL AND {_CODE.format(sql.squeeze('b.clc_code'))} <> '' AS has_other FROM c0 JOIN clc_r_categories a ON a.category_id = named[1] LEFT JOIN clc_r_categories b ON b.category_id = named[2]),
c2 AS (SELECT *, {_KEY.format('raw_code')} AS e, {_KEY.format('other_code')} AS k, lower({sql.squeeze("concat_ws(' ', title, content, CASE WHEN source = '" + acceptance.SEARCHED + "' THEN " + sql.squeeze('source_url') + " END)")}) AS body,
   list_filter(list_transform(string_split(query_terms, '|'), lambda x: {sql.squeeze('x')}), lambda x: x <> '') AS terms FROM c1),
c3 AS (SELECT *, list_filter(coalesce(terms, []), lambda x: contains(body, lower(x)) OR (source = '{acceptance.SEARCHED}' AND length({_STEM}) >= 2 AND contains(body, {_STEM}))) AS matched, coalesce(has_other AND e <> '' AND starts_with(k, e), false) AS verified FROM c2),
c4 AS (SELECT *, coalesce(source = '{acceptance.SEARCHED}' AND len(matched) = 0 AND coalesce(n_chars // 10, 0) BETWEEN 1 AND 100 AND NOT regexp_matches(title, '{'|'.join(acceptance.INSTITUTIONS)}')
   AND {' + '.join(f"contains(body, '{a}')::INT" for a in acceptance.ANCHORS)} >= 2, false) AS ranked FROM c3),
c5 AS (SELECT *, CASE WHEN title = '' THEN 'missing_title' WHEN length(content) < {MIN_CHARS} THEN 'text_too_short' WHEN coalesce(source, '') = '' OR coalesce(document_id, '') = '' THEN 'missing_source_identity' WHEN coalesce(license, '') = '' THEN 'missing_access_basis'
   WHEN source = '{acceptance.EXPORTED}' AND NOT regexp_matches(' ' || upper('CLC=' || raw_code) || ' ', '[^A-Z0-9.]' || regexp_escape({_CODE.format(sql.squeeze('raw_code'))}) || '[^A-Z0-9.]') THEN 'cnki_query_missing_target_clc_code'
   WHEN has_other AND NOT (e <> '' AND k <> '' AND (starts_with(k, e) OR starts_with(e, k))) THEN 'source_clc_conflict'
   WHEN source = '{acceptance.SEARCHED}' AND len(matched) = 0 AND NOT ranked THEN 'query_terms_not_found' WHEN source = '{acceptance.EXPORTED}' AND NOT verified AND len(matched) = 0 THEN 'cnki_unverified_no_term_match' END AS reason,
   CASE WHEN verified THEN 'source_metadata' WHEN source = '{acceptance.EXPORTED}' THEN 'cnki_batch_query_mapping' WHEN ranked THEN 'mediawiki_ranked_search_mapping' ELSE 'query_term_match' END AS basis,
   CASE WHEN verified THEN 0.98::DOUBLE WHEN source = '{acceptance.EXPORTED}' AND len(matched) > 0 THEN 0.8::DOUBLE WHEN source = '{acceptance.EXPORTED}' THEN 0.72::DOUBLE WHEN ranked THEN 0.45::DOUBLE ELSE 0.62::DOUBLE END AS confidence,
   len(list_filter(matched, lambda x: contains(lower(title), lower(x)))) AS in_title FROM c4),
c6 AS (SELECT *, CASE WHEN verified THEN 0.98::DOUBLE ELSE floor(least((CASE WHEN source = '{acceptance.SEARCHED}' THEN 0.48::DOUBLE ELSE 0.58::DOUBLE END) + 0.2::DOUBLE * in_title + 0.08::DOUBLE * (len(matched) - in_title) + (CASE WHEN length(content) >= 200 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END), 0.95::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS relevance FROM c5),
c7 AS (SELECT *, floor(least(0.25::DOUBLE + least(length(title) / 100.0::DOUBLE, 0.15::DOUBLE) + least(length(content) / 1200.0::DOUBLE, 0.3::DOUBLE) + (CASE WHEN coalesce(lang, '') = 'en' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) + relevance * 0.2::DOUBLE, 0.99::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS quality FROM c6)
"""


def _judged(spark, d):
    return acceptance.judged(candidates(spark, d), MIN_CHARS)


@query(f"WITH {JUDGED} SELECT doc_id, reason FROM c7")
def candidate_reasons(spark, d):
    """The first reason that rejects a candidate, NULL where it is accepted."""
    return _judged(spark, d).select("doc_id", "reason")


@query(f"WITH {JUDGED} SELECT reason, count(*) AS n FROM c7 WHERE reason IS NOT NULL GROUP BY reason ORDER BY reason")
def rejections_by_reason(spark, d):
    return _judged(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


@query(f"WITH {JUDGED} SELECT doc_id, array_to_string(matched, '|') AS matched_terms, verified, ranked, basis, confidence FROM c7")
def class_assignments(spark, d):
    """Matched terms (for the searched source also by stem) and the basis of each candidate's class."""
    return _judged(spark, d).select("doc_id", F.array_join("matched_terms", "|").alias("matched_terms"), "verified", "ranked", "basis", "confidence")


@query(f"WITH {JUDGED} SELECT doc_id, relevance, quality FROM c7")
def candidate_scores(spark, d):
    return _judged(spark, d).select("doc_id", "relevance", "quality")


@query("SELECT doc_id, " + " + ".join(f"contains(coalesce(text, ''), '{a}')::INT" for a in acceptance.ANCHORS) + " AS anchors FROM documents")
def anchor_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", acceptance.anchor_count(F.coalesce("text", F.lit(""))).alias("anchors"))


_J = "json_extract_string(canonical_json, '{0}')"


@query(f"""WITH u AS (SELECT DISTINCT canonical_json FROM records),
  items AS (SELECT canonical_json, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS item FROM (SELECT canonical_json, CAST(json_extract(canonical_json, '$.classifications') AS JSON[]) AS l FROM u)),
  cls AS (SELECT canonical_json, flatten(list(list_filter([CASE WHEN c.category_id IS NULL THEN 'unknown_category' WHEN json_extract_string(item, '$.clc_code') IS DISTINCT FROM c.clc_code THEN 'clc_code_mismatch' END,
    CASE WHEN NOT starts_with(coalesce(json_extract_string(item, '$.clc_code'), ''), 'R') THEN 'not_clc_r' END], lambda x: x IS NOT NULL) ORDER BY pos)) AS of_classes FROM items LEFT JOIN clc_r_categories c ON c.category_id = json_extract_string(item, '$.category_id') GROUP BY canonical_json),
  e AS (SELECT canonical_json, list_filter([CASE WHEN coalesce({_J.format('$.schema_version')}, '') <> '1.0' THEN 'unsupported_schema_version' END, CASE WHEN NOT coalesce(regexp_matches({_J.format('$.document_id')}, '^doc_[0-9a-f]{{24}}$'), false) THEN 'invalid_document_id' END,
    CASE WHEN coalesce({_J.format('$.source.name')}, '') = '' OR coalesce({_J.format('$.source.record_id')}, '') = '' THEN 'invalid_source' END, CASE WHEN {sql.squeeze(_J.format('$.bibliography.title'))} = '' THEN 'missing_title' END,
    CASE WHEN {sql.squeeze(_J.format('$.text.content'))} = '' THEN 'missing_content' WHEN {_J.format('$.text.content_hash')} IS DISTINCT FROM 'sha256:' || sha256({sql.squeeze(_J.format('$.text.content'))}) THEN 'content_hash_mismatch' END,
    CASE WHEN coalesce(json_array_length(canonical_json, '$.classifications'), 0) = 0 THEN 'missing_classification' END] || coalesce(of_classes, []) ||
    [CASE WHEN json_extract(canonical_json, '$.provenance[0]') IS NULL THEN 'missing_provenance' END, CASE WHEN json_extract(canonical_json, '$.collection') IS NULL THEN 'invalid_collection' END], lambda x: x IS NOT NULL) AS errors FROM u LEFT JOIN (SELECT canonical_json AS cj, of_classes FROM cls) ON cj = canonical_json)
  SELECT run_id, document_id, array_to_string(errors, ',') AS errors FROM records r JOIN e ON e.canonical_json IS NOT DISTINCT FROM r.canonical_json""")
def validation_errors(spark, d):
    """All codes of every canonical document, in order."""
    return acceptance.validation_errors(table(spark, d, "records"), table(spark, d, "clc_r_categories"))

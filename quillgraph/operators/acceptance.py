"""Acceptance of candidates and validation of canonical documents: every reason and code, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, scores, text
from .collect import code_compatible, term_matches

# The source that is searched (its hits may be accepted by rank) and the one that is exported in batches.
SEARCHED, EXPORTED = "mediawiki", "cnki"
SCHEMA_VERSION, PIPELINE_VERSION = "1.0", "1.3"
# Titles of institutions, and words of which a ranked hit holds two or more.
INSTITUTIONS = ("大学", "学院", "医院", "研究所", "研究院", "科学院", "学会", "协会", "委员会", "实验室")
ANCHORS = (
    "医学", "疾病", "健康", "卫生", "治疗", "诊断", "症状", "药物", "手术", "生理", "病理", "护理", "临床", "感染", "肿瘤", "免疫", "患者", "医生",
    "器官", "细胞", "基因", "病毒", "细菌", "流行病", "预防", "康复", "药理", "血液",
)


def anchor_count(c: Column) -> Column:
    """How many of the anchor words the text holds."""
    return reduce(lambda n, a: n + F.contains(c, F.lit(a)).cast("int"), ANCHORS, F.lit(0))


def is_ranked_hit(title: Column, combined: Column, rank: Column) -> Column:
    """A hit among the first hundred, no institution by its title, with two anchor words at least."""
    place = F.coalesce(rank.try_cast("int"), F.lit(0))
    return place.between(1, 100) & ~title.rlike("|".join(INSTITUTIONS)) & (anchor_count(combined) >= 2)


def code_matches(expected: Column, actual: Column) -> Column:
    """The actual code lies under the expected one."""
    e, a = ids.class_key(expected), ids.class_key(actual)
    return (e != "") & F.startswith(a, e)


def judged(candidates: DataFrame, min_chars: int) -> DataFrame:
    """``candidates`` with matched_terms, verified, ranked, reason, basis, confidence, relevance and quality.

    Needs title, abstract, content, keywords, snippets, source_name, source_record_id, access_basis, query_text,
    source_codes, search_rank, has_authors of the candidate and clc_code, terms of its category; NULL lists are empty.
    ``reason`` is the first that rejects it, NULL if it is accepted.
    """
    none = F.array().cast("array<string>")
    c = candidates.withColumn("_title", text.squeeze(F.col("title")))
    abstract = text.squeeze(F.col("abstract"))
    c = c.withColumn("_content", F.when(F.coalesce("content", F.lit("")) != "", text.squeeze(F.col("content"))).otherwise(abstract))
    searched, exported = F.col("source_name") == SEARCHED, F.col("source_name") == EXPORTED
    parts = F.concat(F.array("_title", "_content"), F.transform(F.coalesce("keywords", none), text.squeeze))
    parts = F.concat(parts, F.when(searched, F.transform(F.coalesce("snippets", none), text.squeeze)).otherwise(none))
    c = c.withColumn("_all", F.lower(text.squeeze(F.array_join(parts, " "))))
    in_text = lambda t: term_matches(t, F.col("_all"), False) | (searched & term_matches(t, F.col("_all"), True))
    c = c.withColumn("matched_terms", F.filter(F.coalesce("terms", none), lambda t: F.coalesce(in_text(t), F.lit(False))))
    codes = F.filter(F.transform(F.coalesce("source_codes", none), ids.class_code), lambda x: x != "")
    c = c.withColumn("_codes", codes).withColumn("verified", F.exists("_codes", lambda x: code_matches(F.col("clc_code"), x)))
    matched = F.size("matched_terms") > 0
    c = c.withColumn("ranked", F.coalesce(searched & ~matched & is_ranked_hit(F.col("_title"), F.col("_all"), F.col("search_rank")), F.lit(False)))
    empty = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    reason = (
        F.when(F.col("_title") == "", "missing_title")
        .when(F.length("_content") < min_chars, "text_too_short")
        .when(empty("source_name") | empty("source_record_id"), "missing_source_identity")
        .when(empty("access_basis"), "missing_access_basis")
        .when(exported & ~ids.declares_code(F.col("query_text"), F.col("clc_code")), "cnki_query_missing_target_clc_code")
        .when((F.size("_codes") > 0) & ~F.exists("_codes", lambda x: code_compatible(F.col("clc_code"), x)), "source_clc_conflict")
        .when(searched & ~matched & ~F.col("ranked"), "query_terms_not_found")
        .when(exported & ~F.col("verified") & ~matched, "cnki_unverified_no_term_match")
    )
    basis = F.when(F.col("verified"), "source_metadata").when(exported, "cnki_batch_query_mapping").when(F.col("ranked"), "mediawiki_ranked_search_mapping").otherwise("query_term_match")
    confidence = F.when(F.col("verified"), 0.98).when(exported & matched, 0.80).when(exported, 0.72).when(F.col("ranked"), 0.45).otherwise(0.62)
    c = c.withColumn("reason", reason).withColumn("basis", basis).withColumn("confidence", confidence)
    low = F.lower("_title")
    in_title = F.size(F.filter("matched_terms", lambda t: F.contains(low, F.lower(text.squeeze(t)))))
    c = c.withColumn("relevance", scores.relevance(F.col("source_name"), in_title, F.size("matched_terms") - in_title, F.length("_content"), F.col("verified")))
    c = c.withColumn("quality", scores.document_quality(F.length("_title"), F.length("_content"), F.col("has_authors"), F.col("relevance")))
    return c.drop("_title", "_content", "_all", "_codes")


ASSIGNMENTS = "array<struct<category_id:string,clc_code:string>>"


def validation_errors(records: DataFrame, catalog: DataFrame, keys: tuple[str, ...] = ("run_id", "document_id")) -> DataFrame:
    """``keys, errors`` of canonical documents (canonical_json): the codes in order, those of each assignment once for it.

    ``catalog`` has category_id, clc_code (one row each). Assignments meet it by a join on the exploded ids.
    """
    raw = F.col("canonical_json")
    at = lambda p: F.get_json_object(raw, p)
    is_kind = lambda p, sign: F.coalesce(F.startswith(F.ltrim(at(p)), F.lit(sign)), F.lit(False))
    # equal documents are judged once, under their hash
    r = records.withColumn("_row", F.sha2(F.coalesce(raw, F.lit("")), 256))
    unique = r.select("_row", "canonical_json").dropDuplicates(["_row"])
    items = F.when(is_kind("$.classifications", "["), F.from_json(at("$.classifications"), "array<string>"))
    one = unique.select("_row", F.posexplode(items).alias("pos", "item"))
    one = one.withColumn("object", F.coalesce(F.startswith(F.ltrim("item"), F.lit("{")), F.lit(False)))
    one = one.withColumn("category_id", F.get_json_object("item", "$.category_id")).withColumn("code", F.get_json_object("item", "$.clc_code"))
    cat = catalog.select(F.col("category_id").alias("_id"), F.col("clc_code").alias("_code"))
    one = one.join(cat, one["category_id"] == cat["_id"], "left")
    faults = F.array_compact(
        F.array(
            F.when(F.col("_id").isNull(), "unknown_category").when(~F.col("code").eqNullSafe(F.col("_code")), "clc_code_mismatch"),
            F.when(~F.startswith(F.coalesce("code", F.lit("")), F.lit("R")), "not_clc_r"),
        )
    )
    one = one.select("_row", F.struct("pos", F.when(F.col("object"), faults).otherwise(F.array(F.lit("invalid_classification"))).alias("f")).alias("x"))
    # no more rows than the document's own assignments
    one = one.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"])).alias("of_classes"))
    j = unique.join(one, "_row", "left")
    blank = lambda p: F.coalesce(at(p), F.lit("")) == ""
    content = text.squeeze(at("$.text.content"))
    before = F.array(
        F.when(F.coalesce(at("$.schema_version"), F.lit("")) != SCHEMA_VERSION, "unsupported_schema_version"),
        F.when(~F.coalesce(at("$.document_id").rlike("^doc_[0-9a-f]{24}$"), F.lit(False)), "invalid_document_id"),
        F.when(blank("$.source.name") | blank("$.source.record_id"), "invalid_source"),
        F.when(text.squeeze(at("$.bibliography.title")) == "", "missing_title"),
        F.when(content == "", "missing_content").when(~at("$.text.content_hash").eqNullSafe(ids.text_hash(content)), "content_hash_mismatch"),
        F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "missing_classification"),
    )
    after = F.array(
        F.when(~is_kind("$.provenance[0]", "{"), "missing_provenance"),
        F.when(~is_kind("$.collection", "{"), "invalid_collection").when(F.coalesce(at("$.collection.pipeline_version"), F.lit("")) != PIPELINE_VERSION, "unsupported_pipeline_version"),
    )
    errors = F.array_compact(F.concat(before, F.coalesce("of_classes", F.array().cast("array<string>")), after))
    return r.select(*keys, "_row").join(j.select("_row", F.array_join(errors, ",").alias("errors")), "_row").drop("_row")

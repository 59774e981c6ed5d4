"""Explainable confidence of facts and conflicts of entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology
from ..functions import scores
from ..functions.text import stripped
from .rules import valid


def _named(triples: DataFrame) -> DataFrame:
    kind = lambda c: F.when(stripped(F.col(c)) == "", ontology.UNTYPED).otherwise(stripped(F.col(c)))
    return valid(triples).select(
        "*",
        *(stripped(F.col(c)).alias("_" + c) for c in ("subject", "relation", "object", "source_document_id", "source_text")),
        kind("subject_type").alias("_st"),
        kind("object_type").alias("_ot"),
    )


def type_conflicts(triples: DataFrame, pos: str = "id") -> DataFrame:
    """``entity, n_types, observed, suggested_type, severity`` of the names with several types.

    The commonest type is suggested, of equals the one seen first (subjects before objects of a row).
    """
    t = _named(triples)
    seen = t.select(F.explode(F.array(F.struct(F.col("_subject").alias("name"), F.col("_st").alias("type"), (2 * F.col(pos)).alias("at")), F.struct(F.col("_object").alias("name"), F.col("_ot").alias("type"), (2 * F.col(pos) + 1).alias("at")))).alias("x")).select("x.*")
    by = seen.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    out = by.groupBy("name").agg(
        F.count("*").alias("n_types"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))), ";").alias("observed"),
        F.max_by("type", F.struct("n", -F.col("first"))).alias("suggested_type"),
        F.max("n").alias("most"),
        F.min("n").alias("least"),
    )
    return out.where("n_types > 1").select(F.col("name").alias("entity"), "n_types", "observed", "suggested_type", F.when(F.col("most") >= 3 * F.col("least"), "high").otherwise("medium").alias("severity"))


def support(triples: DataFrame) -> DataFrame:
    """Per (subject, relation, object): distinct documents and distinct (document, text) pieces of evidence."""
    key = ["subject", "relation", "object"]
    t = _named(triples).select(*(F.col("_" + k).alias(k) for k in key), "_source_document_id", "_source_text")
    # equal pieces fall together first, so that one distinct count is left
    t = t.groupBy(*key, "_source_document_id", "_source_text").agg(F.lit(1).alias("_"))
    docs = F.count_distinct(F.when(F.col("_source_document_id") != "", F.col("_source_document_id")))
    return t.groupBy(*key).agg(docs.alias("support_document_count"), F.count_if(F.col("_source_text") != "").alias("support_evidence_count"))


def assess(triples: DataFrame, base: str | None = None) -> DataFrame:
    """Every valid triple with score, level, support, flags and review status.

    Group figures come back by one join per (subject, relation, object), conflicting names by one join each for
    subject and object. ``base`` names the column of the extraction's own confidence.
    """
    t = _named(triples)
    names = type_conflicts(triples).select(F.col("entity").alias("_entity"))
    flagged = lambda side: names.select(F.col("_entity").alias(f"_{side}"), F.lit(True).alias(f"_{side}_conflict"))
    t = t.join(flagged("subject"), "_subject", "left").join(flagged("object"), "_object", "left")
    g = support(triples).select(F.col("subject").alias("_subject"), F.col("relation").alias("_relation"), F.col("object").alias("_object"), "support_document_count", "support_evidence_count")
    t = t.join(g, ["_subject", "_relation", "_object"])
    docs, text = F.col("support_document_count"), F.length("_source_text")
    mismatch = ontology.mismatched(F.col("_relation"), F.col("_st"), F.col("_ot"))
    conflict = F.coalesce(F.col("_subject_conflict"), F.lit(False)) | F.coalesce(F.col("_object_conflict"), F.lit(False))
    raw = F.col(base).cast("double") if base else F.lit(None).cast("double")
    score = scores.fact_score(raw, docs, text, mismatch, conflict)
    flags = F.array_compact(
        F.array(
            F.when(mismatch, "entity_type_mismatch"),
            F.when(conflict, "entity_type_conflict"),
            F.when(docs == 0, "no_source_document"),
            F.when(text == 0, "no_evidence").when(text < 12, "short_evidence"),
            F.when(docs == 1, "single_source"),
        )
    )
    keep = [F.col(c) for c in triples.columns if c not in ("confidence", "extraction_confidence")]
    out = t.select(*keep, score.alias("confidence"), "support_document_count", "support_evidence_count", F.array_join(flags, ",").alias("quality_flags"))
    return out.withColumn("confidence_level", scores.confidence_level(F.col("confidence"), 0.8, 0.6, ("high", "medium", "review"))).withColumn("review_status", F.when(F.col("quality_flags") != "", "warning").otherwise("unreviewed"))

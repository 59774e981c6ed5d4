"""Queries p1 to p9 (without p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe, canonical, facts, increment, mixing, neardup, quality, truncation


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.duplicate_facts(table(spark, sf_dir, "triples"))


def p3_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.unique_facts(table(spark, sf_dir, "triples"))


def _text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, fields in (("documents", "doc_id", ("title", "content")), ("triples", "id", ("subject", "object"))):
        t = table(spark, sf_dir, name)
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))).alias("p")
        part = t.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), pairs).select("table_name", "row_key", "p.*")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalize(_text_values(spark, sf_dir)).where("canonical <> value").select("table_name", "row_key", "field_name")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalize(_text_values(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("is_cut").select("doc_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "documents"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "content").select(F.col("first").alias("first_doc_id"), F.col("id").alias("doc_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return increment.repeated_records(table(spark, sf_dir, "records"), table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))


def p8_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "source_mix"))


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = table(spark, sf_dir, "common_words")
    return quality.rate(quality.text_stats(table(spark, sf_dir, "documents"), common), common)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_stats(spark, sf_dir).where("NOT is_prose").select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p6_found": p6_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_schedule": p8_schedule,
    "p9_stats": p9_stats,
    "p9_found": p9_found,
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p7_ids": p7_ids,
    "p3_found": p3_found,
    "p3_facts": p3_facts,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
}

ORACLE: dict[str, str] = {}

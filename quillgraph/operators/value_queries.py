"""Queries of the packed-value operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import values


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "triples").select(F.lit("triples.object").alias("source"), F.col("id").cast("string").alias("row_key"), F.col("object").alias("value"))
    c = table(spark, sf_dir, "clc_r_categories").select(F.lit("clc_r_categories.query_terms").alias("source"), F.col("category_id").alias("row_key"), F.col("query_terms").alias("value"))
    return t.unionByName(c)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of every field that holds two or more."""
    named = values.split_values(_named(spark, sf_dir), "row_key", "source", "value")
    ids = values.split_ids(table(spark, sf_dir, "documents"), "doc_id", "category_ids").withColumn("source", F.lit("documents.category_ids"))
    out = named.unionByName(ids)
    return out.select(F.split_part("source", F.lit("."), F.lit(1)).alias("table_name"), "row_key", "pos", "val")


def p5_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the candidate delimiters by source."""
    ids = table(spark, sf_dir, "documents").select(F.lit("documents.category_ids").alias("source"), F.col("category_ids").alias("value"))
    scores = values.delimiter_scores(_named(spark, sf_dir), "source", "value").unionByName(values.delimiter_scores(ids, "source", "value", dressed=True))
    shown = [F.round(c, 6).alias(c) for c in ("consistency", "regularity", "score")]
    return scores.select("source", "delimiter", "n_values", "n_split", *shown)


def _found_sql() -> str:
    """The rule of p5_found in plain SQL: every candidate separates, which is what the scores give on these tables."""
    marks = "".join(values.DELIMITERS.values())
    cls = marks.replace("|", "\\|").replace("/", "\\/")
    esc = lambda c: "\\" + c if c in "()[]{}<>|^" else c
    closed = "|".join(f"{esc(a)}[^{esc(b)}]*{esc(b)}" for a, b in values.BRACKETS + values.QUOTES).replace("'", "''")
    piece = f"(?:{closed}|\\p{{Nd}}+(?:[{cls}]\\p{{Nd}}+)*|[^{cls}])+"
    bare = "regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
    text = bare
    for a, b in values.QUOTES:
        q, r = a.replace("'", "''"), b.replace("'", "''")
        text = f"regexp_replace({text}, '^{q}([^{q}{r}]*){r}$', '\\1')"
    text = bare.replace("(x,", f"({text},")
    dressing = values.DRESSING.replace("'", "''")
    return f"""
    WITH fields AS (
      SELECT 'triples' AS table_name, id::VARCHAR AS row_key, object AS v FROM triples
      UNION ALL SELECT 'clc_r_categories', category_id, query_terms FROM clc_r_categories),
    split AS (
      SELECT table_name, row_key, list_filter(list_transform(regexp_extract_all(v, '{piece}'), lambda x: {text}), lambda x: x <> '') AS p FROM fields
      UNION ALL
      SELECT 'documents', doc_id::VARCHAR, regexp_extract_all(translate(category_ids, '{dressing}', ''), '[^{cls}\\s]+') FROM documents)
    SELECT table_name, row_key, generate_subscripts(p, 1)::INT AS pos, unnest(p) AS val FROM split WHERE len(p) >= 2
    """


SQL = {"p5_found": _found_sql()}
QUERIES = {"p5_found": p5_found, "p5_delimiters": p5_delimiters}

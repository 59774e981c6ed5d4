"""Stored tables: merges written as joins and rewrites, exports of facts with their evidence.

A key that is NULL equals nothing, so rows with a NULL key part are never merged (as UNIQUE constraints have it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_KEY = ("subject", "relation", "object", "object_type")


def _filled(c: Column, other: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)


def export_facts(triples: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per evidence, empty document or text filled from the triple; a triple without evidence gives one row."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.col("triple_id"), F.col("source_document_id").alias("_doc"), F.col("source_text").alias("_text"))
    t = triples.join(e, triples["id"] == e["triple_id"], "left")
    return t.select("id", "evidence_id", "subject", "subject_type", "relation", "object", "object_type", _filled(F.col("_doc"), F.col("source_document_id")).alias("source_document_id"), _filled(F.col("_text"), F.col("source_text")).alias("source_text"))


def upsert(target: DataFrame, source: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Rows of both by ``key``: source wins in the columns of ``update``, the target keeps its other columns.

    Both have one row per key; columns of ``target`` that ``source`` lacks stay NULL in new rows.
    """
    s = source.select(F.col(key).alias("_key"), *(F.col(c).alias("_" + c) for c in source.columns if c != key), F.lit(True).alias("_new"))
    j = target.withColumn("_old", F.lit(True)).join(s, F.col(key) == F.col("_key"), "full")
    cols = []
    for c in target.columns:
        if c == key:
            cols.append(F.coalesce(key, "_key").alias(key))
        elif c not in source.columns:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(F.col("_new"), F.col("_" + c)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col("_" + c)).alias(c))
    return j.select(*cols)


def insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(target.columns))


def insert_or_ignore(existing: DataFrame, batch: DataFrame, pos: str = "id", key: tuple[str, ...] = FACT_KEY) -> DataFrame:
    """Facts of ``batch`` (the first of each key) that ``existing`` lacks; NULL key parts never match."""
    w = Window.partitionBy(*key).orderBy(pos)
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    first = batch.withColumn("_rank", F.when(whole, F.row_number().over(w)).otherwise(1)).where("_rank = 1").drop("_rank")
    return first.join(existing.select(*key), list(key), "left_anti").select(batch.columns)


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """One row (the smallest id) per (triple_id, document, text); rows with a NULL among these stay all."""
    keys = ("triple_id", "source_document_id", "source_text")
    whole = evidence.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    rest = evidence.where(" OR ".join(f"{k} IS NULL" for k in keys))
    return whole.groupBy(*keys).agg(F.min("id").alias("id")).select("id", *keys).unionByName(rest.select("id", *keys))


def delete_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def bump_trained(triples: DataFrame, used: DataFrame) -> DataFrame:
    """``trained`` one higher for every triple whose id is used, however often."""
    u = used.select(F.col("id").alias("_used")).where("_used IS NOT NULL").distinct()
    return triples.join(u, F.col("id") == F.col("_used"), "left").withColumn("trained", (F.coalesce("trained", F.lit(0)) + F.col("_used").isNotNull().cast("int")).cast("int")).drop("_used")


def changed(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents without an equal id and hash in ``state``; a missing hash counts as changed."""
    done = state.where("content_hash IS NOT NULL").select("document_id", "content_hash").distinct()
    return docs.join(done, ["document_id", "content_hash"], "left_anti").select(docs.columns)


def seed_state(triples: DataFrame, docs: DataFrame, state: DataFrame) -> DataFrame:
    """``document_id, content_hash`` of documents with facts and a hash that the state lacks."""
    with_facts = triples.select(F.col("source_document_id").alias("document_id")).where("document_id IS NOT NULL").distinct()
    d = docs.where("coalesce(content_hash, '') <> ''").select("document_id", "content_hash")
    return d.join(with_facts, "document_id", "left_semi").join(state.select("document_id"), "document_id", "left_anti")


def merge_reports(new: DataFrame, old: DataFrame, key: str = "document_id") -> DataFrame:
    """Full outer merge by ``key``: the new row wins."""
    o = old.select(F.col(key).alias("_key"), *(F.col(c).alias("_" + c) for c in old.columns if c != key))
    j = new.withColumn("_new", F.lit(True)).join(o, F.col(key) == F.col("_key"), "full")
    return j.select(F.coalesce(key, "_key").alias(key), *(F.when(F.col("_new"), F.col(c)).otherwise(F.col("_" + c)).alias(c) for c in new.columns if c != key))


def publish(df: DataFrame, root: str, run_id: str) -> str:
    """Write an immutable generation; an existing one is an error."""
    path = f"{root.rstrip('/')}/generations/{run_id}/documents"
    df.write.mode("errorifexists").json(path)
    return path

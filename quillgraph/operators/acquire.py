"""Acquisition: plans, batch manifests, search hits with their pages, and the choice of new documents."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..runtime import discard, materialize

# The wording of a plan's query for the exported source.
EXPORT_QUERY = ("高级检索：中图分类号=", "；主题可辅以 ")


def query_hint(exported: bool, code: Column, terms: Column) -> Column:
    """What to search for: the terms, for the exported source with the exact code."""
    either = F.array_join(terms, " OR ")
    return F.concat(F.lit(EXPORT_QUERY[0]), code, F.lit(EXPORT_QUERY[1]), either) if exported else either


def _terms() -> Column:
    return F.filter(F.transform(F.split("query_terms", "\\|"), text.squeeze), lambda t: t != "")


def collection_plan(catalog: DataFrame, exported: bool, per_category: int | None = None) -> DataFrame:
    """One row per category of ``catalog`` (see ``collect.catalog``) with its target, terms, query and file to export to."""
    c = catalog.withColumn("_terms", _terms())
    return c.select(
        "category_id",
        "clc_code",
        "clc_name",
        (F.lit(per_category) if per_category else F.col("target_count")).alias("target_count"),
        F.array_join("_terms", "|").alias("query_terms"),
        query_hint(exported, F.col("clc_code"), F.col("_terms")).alias("recommended_query"),
        (F.concat("category_id", F.lit("__batch001.txt")) if exported else F.lit("")).alias("suggested_export_file"),
    )


def batch_template(catalog: DataFrame, access_basis: str = "", rights_statement: str = "") -> DataFrame:
    """The manifest of one batch per category, to be filled with exports."""
    c = catalog.withColumn("_terms", _terms())
    return c.select(
        F.concat(F.lit("cnki_"), "category_id", F.lit("_001")).alias("batch_id"),
        F.concat("category_id", F.lit("__batch001.txt")).alias("file"),
        "category_id",
        query_hint(True, F.col("clc_code"), F.col("_terms")).alias("query_text"),
        F.lit(access_basis).alias("access_basis"),
        F.lit(rights_statement).alias("rights_statement"),
    )


def manifest_faults(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """``batch_id, file, category_id, faults`` of a batch manifest (pos gives its order), faults in the order they are looked for.

    Empty fields, an id that an earlier row has, an unknown category, a query without the category's exact code, and a
    file outside the inbox (absolute, or climbing out of it).
    """
    m = manifest.select("pos", *(text.squeeze(F.col(c)).alias(c) for c in ("batch_id", "file", "category_id", "query_text")))
    known = catalog.select(F.col("category_id").alias("_id"), F.col("clc_code").alias("_code"))
    m = m.withColumn("_nth", F.row_number().over(Window.partitionBy("batch_id").orderBy("pos"))).join(known, F.col("category_id") == F.col("_id"), "left")
    empty = (F.col("batch_id") == "") | (F.col("file") == "") | (F.col("category_id") == "") | (F.col("query_text") == "")
    # how deep the path stands after each of its parts; below 0 it has left the inbox
    step = lambda a, p: F.struct(
        (a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).cast("int").alias("at"),
        F.least(a["low"], (a["at"] + F.when(p == "..", -1).otherwise(0)).cast("int")).alias("low"),
    )
    low = F.aggregate(F.split("file", "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), step)["low"]
    faults = F.array_compact(
        F.array(
            F.when(empty, "empty_field"),
            F.when((F.col("_nth") > 1) & (F.col("batch_id") != ""), "repeated_batch"),
            F.when(F.col("_id").isNull(), "unknown_category"),
            F.when((F.coalesce("_code", F.lit("")) != "") & ~ids.declares_code(F.col("query_text"), F.col("_code")), "code_not_declared"),
            F.when(F.startswith("file", F.lit("/")) | (low < 0), "outside_inbox"),
        )
    )
    return m.select("batch_id", "file", "category_id", faults.alias("faults"))


def batch_records(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Parsed records (path, record, ..) with the batch of their file, numbered within each category in file order.

    ``manifest`` has file, batch_id, category_id and its order ``pos``; files of no batch are left out.
    """
    m = manifest.select(F.col("file").alias("_file"), "batch_id", "category_id", "pos")
    j = records.join(m, F.substring_index("path", "/", -1) == F.col("_file")).drop("_file")
    w = Window.partitionBy("category_id").orderBy("pos", "record")
    return j.withColumn("number", F.row_number().over(w) - 1)


def page_of(records: DataFrame, start: int, limit: int) -> DataFrame:
    """The page of each category's numbered records from ``start`` on."""
    return records.where((F.col("number") >= start) & (F.col("number") < start + limit))


def plain_snippet(c: Column) -> Column:
    """A search snippet without tags and entities."""

    def plain(s: pd.Series) -> pd.Series:
        return s.map(unescape, na_action="ignore")

    return text.squeeze(text.nfkc(F.pandas_udf(plain, "string")(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))))


def pages_with_hits(pages: DataFrame, hits: DataFrame, key: str = "page_id") -> DataFrame:
    """Every page with rank and snippet of its search hit (of several hits the last), NULL where it has none."""
    last = hits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("search_rank", "search_snippet"), "search_rank").alias("_hit"))
    j = pages.join(last, F.col(key) == F.col("_key"), "left")
    return j.select(*pages.columns, F.col("_hit.search_rank").alias("search_rank"), F.col("_hit.search_snippet").alias("search_snippet"))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or the time until a date; NULL if it is neither."""
    seconds = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = date.cast("double") - now.cast("double")
    return F.greatest(F.lit(0.0), F.coalesce(seconds, until))


def unseen(candidates: DataFrame, existing: DataFrame, per_term: int = 2, min_chars: int = 80) -> DataFrame:
    """New candidates (term, rank, document_id, title, content, content_hash): neither id nor title known, at most
    ``per_term`` of each term in rank order, long enough, and of equal texts or ids the first by (term, rank)."""
    c = candidates.join(existing.select("document_id").distinct(), "document_id", "left_anti").join(existing.select("title").where("title IS NOT NULL").distinct(), "title", "left_anti")
    once = Window.partitionBy("document_id").orderBy("term", "rank")
    c = c.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy("rank", "document_id"))).where(F.col("_n") <= per_term)
    c = c.where(F.length(text.squeeze(F.col("content"))) >= min_chars)
    by_text = Window.partitionBy("content_hash").orderBy("term", "rank", "document_id")
    return c.withColumn("_n", F.row_number().over(by_text)).where((F.col("_n") == 1) | F.col("content_hash").isNull()).select(candidates.columns)


def first_by_any_key(rows: DataFrame, order: str, keys: list[str], max_rounds: int = 200) -> DataFrame:
    """Rows accepted one after another in the order of the unique column ``order``: one that shares any of ``keys`` with
    an accepted row is dropped, and leaves no keys behind. NULL keys agree with nothing.

    Rounds accept the first undecided row of all its keys and drop what it meets, so they end after as many rounds as
    the longest chain of rows that hang on one another. Keys are aggregated map-side.
    """
    named = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(k + "="), F.col(k).cast("string"))) for k in keys)))
    links = materialize(rows.select(F.col(order).alias("at"), F.explode(named).alias("key")), "row-keys")
    state = materialize(rows.select(F.col(order).alias("at"), F.lit(None).cast("boolean").alias("taken")), "row-state")
    for _ in range(max_rounds):
        if state.where("taken IS NULL").isEmpty():
            out = rows.join(state.where("taken").select(F.col("at").alias(order)), order, "left_semi")
            out = materialize(out, "first-rows")
            discard(links, state)
            return out
        open_ = links.join(state.where("taken IS NULL").select("at"), "at")
        taken = links.join(state.where("taken").select("at"), "at").select("key").distinct().withColumn("gone", F.lit(True))
        firsts = open_.groupBy("key").agg(F.min("at").alias("first"))
        seen = open_.join(firsts, "key").join(taken, "key", "left")
        seen = seen.groupBy("at").agg(F.bool_and(F.col("first") == F.col("at")).alias("leads"), F.bool_or(F.coalesce("gone", F.lit(False))).alias("met"))
        verdict = F.when(F.col("taken").isNotNull(), F.col("taken")).when(F.col("met"), False).when(F.coalesce("leads", F.lit(True)), True)
        step = materialize(state.join(seen, "at", "left").select("at", verdict.alias("taken")), "row-state")
        discard(state)
        state = step
    raise RuntimeError("rows did not settle")


def sampled(pages: DataFrame, order: str, per_category: int, limit: int, min_chars: int = 80) -> DataFrame:
    """A sample of complete pages (category_id, title, content, source_url): different by text and by URL, at most
    ``per_category`` of a category and ``limit`` in all, with running ids. Categories follow the order of their first page.

    A page that the caps leave out still counts as seen for later ones.
    """
    clean = pages.select(F.col(order), "category_id", *(text.squeeze(F.col(c)).alias(c) for c in ("title", "content", "source_url")))
    clean = clean.where((F.col("title") != "") & (F.col("source_url") != "") & (F.length("content") >= min_chars)).withColumn("content_hash", ids.text_hash(F.col("content")))
    kept = first_by_any_key(clean, order, ["content_hash", "source_url"])
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("category_id").orderBy(order))).where(F.col("_n") <= per_category)
    # the limit is a top-k of the report, so its rows fit one task
    top = kept.orderBy(order).limit(limit).withColumn("_n", F.row_number().over(Window.orderBy(order)))
    return top.select(F.format_string("doc_%06d", "_n").alias("document_id"), "category_id", "title", "content", "source_url", "content_hash")


def capacity(catalog: DataFrame, min_categories: int, min_documents: int, min_each: int, per_category: int | None = None) -> DataFrame:
    """One row: reviewed and eligible categories, the documents they can give, and the first gate that fails (NULL: none)."""
    target = F.lit(per_category) if per_category else F.col("target_count")
    on = F.coalesce("reviewed", F.lit(False))
    r = catalog.agg(F.count_if(on).alias("reviewed"), F.count_if(on & (target >= min_each)).alias("eligible"), F.coalesce(F.sum(F.when(on, target)), F.lit(0)).alias("capacity"))
    fault = F.when(F.col("reviewed") < min_categories, "too_few_reviewed").when(F.col("eligible") < min_categories, "too_few_eligible").when(F.col("capacity") < min_documents, "too_small")
    return r.withColumn("fault", fault)


def prefix_changed(consumed: DataFrame, source: DataFrame, pos: str = "pos", content: str = "fingerprint") -> DataFrame:
    """Rows of ``consumed`` that ``source`` no longer has at their place: an append-only source has none."""
    old = consumed.select(pos, F.col(content).alias("_old"))
    return old.join(source.select(pos, F.col(content).alias("_new")), pos, "left").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(pos)

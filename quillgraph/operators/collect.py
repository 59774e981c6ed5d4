"""Collected records: canonical JSON, categories, validation and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import dedupe

CANONICAL = (
    "schema_version string, document_id string, source struct<name:string,record_id:string,url:string>, "
    "bibliography struct<title:string,authors:array<string>,doi:string>, text struct<content:string,language:string,content_hash:string>, "
    "classifications array<struct<category_id:string,scheme:string,verified:boolean,confidence:double>>, quality struct<status:string,score:double>"
)


def parsed(records: DataFrame) -> DataFrame:
    return records.withColumn("doc", F.from_json("canonical_json", CANONICAL))


def legacy_rows(records: DataFrame) -> DataFrame:
    """The nine fields of a flat document, of the first record (by created_at, run_id) of each document_id."""
    r = parsed(records).withColumn("_at", F.struct("created_at", "run_id"))
    d, raw = F.col("doc"), F.col("canonical_json")
    ids_ = F.transform(d["classifications"]["category_id"], lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    flat = r.select(
        "_at", d["document_id"].alias("document_id"),
        F.concat(F.lit("["), F.coalesce(F.array_join(ids_, ", "), F.lit("")), F.lit("]")).alias("category_ids"),
        d["bibliography"]["title"].alias("title"), d["text"]["content"].alias("content"),
        F.coalesce(d["source"]["url"], F.lit("")).alias("source_url"),
        F.coalesce(F.get_json_object(raw, "$.source.rights_statement"), F.lit("unknown")).alias("license"),
        F.coalesce(F.get_json_object(raw, "$.provenance[0].collected_at"), F.lit("")).alias("collected_at"),
        d["text"]["content_hash"].alias("content_hash"), d["quality"]["score"].alias("quality_score"),
    )
    return dedupe.first_seen(flat, ("document_id",), "_at").drop("_at")


def category_list(c: Column) -> Column:
    """A list of ids from a JSON list, or from any other text as one id; NULL and '' as the empty list."""
    as_list = F.from_json(c, "array<string>")
    return F.coalesce(F.when(F.coalesce(text.strip(c), F.lit("")) == "", F.array().cast("array<string>")), F.when(c.rlike("^\\s*\\["), as_list), F.array(text.strip(c)))


def catalog(raw: DataFrame) -> DataFrame:
    """Typed categories with their faults: codes normalised, flags as booleans."""
    c = raw.select(
        text.squeeze(F.col("category_id")).alias("category_id"),
        ids.class_code(F.col("clc_code")).alias("clc_code"),
        text.squeeze(F.col("clc_name")).alias("clc_name"),
        "parent_code",
        "query_terms",
        "target_count",
        ids.flag(F.col("enabled")).alias("enabled"),
        ids.flag(F.col("reviewed")).alias("reviewed"),
        text.squeeze(F.col("authority_source")).alias("authority_source"),
    )
    faults = F.array_compact(
        F.array(
            F.when(F.col("category_id") == "", "no_id"),
            F.when(~F.col("clc_code").startswith("R") | (F.col("clc_code") == "R"), "bad_code"),
            F.when(F.col("clc_name") == "", "no_name"),
            F.when(F.coalesce("target_count", F.lit(0)) <= 0, "bad_target"),
            F.when(text.squeeze(F.col("query_terms")) == "", "no_terms"),
            F.when(F.col("authority_source") == "", "no_authority"),
            F.when(F.col("enabled").isNull() | F.col("reviewed").isNull(), "bad_flag"),
        )
    )
    return c.withColumn("faults", F.array_join(faults, ","))


def checked_catalog(raw: DataFrame, enabled_only: bool = True) -> DataFrame:
    """The typed categories, if none has a fault and ids and codes are unique; else an error that names the first ones."""
    c = catalog(raw)
    bad = c.where("faults <> ''").select(F.concat_ws(": ", "category_id", "faults").alias("x"))
    for field in ("category_id", "clc_code"):
        bad = bad.unionByName(c.groupBy(field).agg(F.count("*").alias("n")).where("n > 1").select(F.concat(F.lit(f"repeated {field}: "), field).alias("x")))
    first = [r.x for r in bad.limit(5).collect()]
    if first:
        raise ValueError("; ".join(first))
    out = c.where("enabled") if enabled_only else c
    if out.isEmpty():
        raise ValueError("no category")
    return out


def select_categories(categories: DataFrame, selectors: list[str]) -> DataFrame:
    """Categories named by id or by code (in any case), in the order of the selectors, each once; no selector selects all.

    A selector that names none is an error. Selectors are a caller's short list.
    """
    wanted = [x.strip() for x in selectors if x.strip()]
    if not wanted:
        return categories
    spark = categories.sparkSession
    s = spark.createDataFrame(list(enumerate(wanted)), "at int, name string")
    by_id = s.join(categories, F.col("name") == F.col("category_id"))
    left = s.join(by_id.select("at"), "at", "left_anti")
    by_code = left.join(categories, F.upper("name") == F.col("clc_code"))
    found = by_id.unionByName(by_code)
    missing = [r.name for r in s.join(found.select("at").distinct(), "at", "left_anti").orderBy("at").collect()]
    if missing:
        raise ValueError(f"unknown categories: {', '.join(missing)}")
    firsts = found.groupBy("category_id").agg(F.min("at").alias("at"))
    return categories.join(firsts, "category_id").orderBy("at", "category_id").select(categories.columns)


def catalog_terms(raw: DataFrame) -> DataFrame:
    """``category_id, pos, term`` of enabled and reviewed categories, terms divided by plain bars."""
    on = raw.where((F.lower(F.trim("enabled")) == "true") & (F.lower(F.trim("reviewed")) == "true"))
    terms = F.filter(F.transform(F.split("query_terms", "\\|"), text.squeeze), lambda t: t != "")
    return on.select("category_id", F.posexplode(terms).alias("pos", "term"))


def term_matches(term: Column, where: Column, stem: bool) -> Column:
    """The term, or its stem without general fragments, stands in the text; both in lower case."""
    t = F.lower(text.squeeze(term))
    hit = (t != "") & F.contains(where, t)
    if stem:
        s = t
        # Fragments that a stem leaves out.
        for f in ("系统疾病", "性疾病", "疾病", "医学", "科学", "学科", "疗法", "治疗", "诊断", "检查"):
            s = F.replace(s, F.lit(f), F.lit(""))
        s = F.regexp_replace(s, "学$", "")
        hit = hit | ((F.length(s) >= 2) & F.contains(where, s))
    return F.coalesce(hit, F.lit(False))


def code_compatible(expected: Column, actual: Column) -> Column:
    e, a = ids.class_key(expected), ids.class_key(actual)
    return (e != "") & (a != "") & (F.startswith(a, e) | F.startswith(e, a))


def category_counts(records: DataFrame, categories: DataFrame) -> DataFrame:
    """``category_id, documents`` of every category, 0 where no document names it; a document counts once a category."""
    r = parsed(records).select(F.col("doc.document_id").alias("d"), F.explode("doc.classifications.category_id").alias("category_id"))
    n = r.groupBy("category_id").agg(F.count_distinct("d").alias("documents"))
    return categories.select("category_id").join(n, "category_id", "left").fillna(0, ["documents"])


def audit(counts: DataFrame, categories: DataFrame, min_categories: int, min_documents: int, min_each: int, documents: DataFrame) -> DataFrame:
    """One row: the gates' actual figures and whether all pass."""
    j = counts.join(categories.select("category_id", "reviewed"), "category_id")
    by = j.agg(F.count_if((F.col("documents") >= min_each) & F.col("reviewed")).alias("reviewed_categories"), F.count_if(F.col("documents") < min_each).alias("shortfalls"), F.count_if(~F.col("reviewed") & (F.col("documents") > 0)).alias("unreviewed_with_documents"))
    n = documents.agg(F.count_distinct("document_id").alias("unique_documents"))
    # one row each
    return by.join(F.broadcast(n)).withColumn("passed", (F.col("reviewed_categories") >= min_categories) & (F.col("unique_documents") >= min_documents))


def identity_keys(records: DataFrame) -> DataFrame:
    """``run_id, document_id, keys`` by which a record is recognised: record, DOI, URL and content of its source."""
    d = F.col("doc")
    src = d["source"]["name"]
    doi, url = ids.plain_doi(d["bibliography"]["doi"]), ids.canonical_url(d["source"]["url"])
    keys = F.array_distinct(
        F.array_compact(
            F.array(
                F.concat(src, F.lit("|record|"), F.lower(text.squeeze(d["source"]["record_id"]))),
                F.when(doi != "", F.concat(src, F.lit("|doi|"), doi)),
                F.when(url != "", F.concat(src, F.lit("|url|"), url)),
                F.concat(src, F.lit("|content|"), d["text"]["content_hash"]),
            )
        )
    )
    return parsed(records).select("run_id", "document_id", keys.alias("keys"))

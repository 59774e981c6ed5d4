"""Sources of text files: JSON arrays and lines, category CSV, and tagged bibliographic exports.

All return DataFrames; bad input is an error where the caller asks for it, else it is left out and counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text

CATALOG = "category_id string, clc_code string, clc_name string, parent_code string, query_terms string, target_count int, enabled string, authority_source string, reviewed string"
TRIPLES = "subject string, subject_type string, relation string, object string, object_type string, source_document_id string, source_text string, confidence double"


def read_json_array(spark: SparkSession, path: str, schema: str = TRIPLES) -> DataFrame:
    """Objects of files that are one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_review_list(spark: SparkSession, path: str, verdict: str = "reject") -> DataFrame:
    """The different keys (id, subject, relation, object, source_document_id) of a review list's facts with the verdict;
    entries without id, subject or object are left out."""
    schema = "id long, subject string, relation string, object string, source_document_id string, review string"
    rows = read_json_array(spark, path, schema).where(F.col("review") == verdict)
    rows = rows.where("id IS NOT NULL AND coalesce(subject, '') <> '' AND coalesce(object, '') <> ''")
    return rows.select("id", "subject", "relation", "object", "source_document_id").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Objects of lines; blank lines are skipped. ``strict``: a line that is no object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Category CSV with a header, which may begin with a byte order mark."""
    return spark.read.option("header", True).option("escape", "\"").option("encoding", "UTF-8").option("enforceSchema", False).schema(CATALOG).csv(path)


def read_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """``path, encoding, content`` of whole files in UTF-8 (with or without mark) or GB18030; web pages are an error row.

    A file is a record of its own and small; ``error`` names what can't be read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                for enc in ("utf-8-sig", "gb18030"):
                    try:
                        content = bytes(raw).decode(enc)
                        break
                    except UnicodeDecodeError:
                        content = None
                error = "encoding" if content is None else "web page" if re.search(r"<html|captcha|验证码", content[:5000], re.I) else None
                out.append((p, enc if content is not None else None, content, error))
            yield pd.DataFrame(out, columns=["path", "encoding", "content", "error"])

    return files.mapInPandas(run, "path string, encoding string, content string, error string")


# Tags of the exports.
TAGS = (
    "RT", "SR", "A1", "A2", "A3", "A4", "AU", "AD", "T1", "T2", "TI",
    "JF", "JO", "YR", "PY", "FD", "IS", "OP", "K1", "KW", "AB", "N2",
    "SN", "CN", "LA", "DS", "DO", "DI", "UL", "UR", "LK", "ID", "CL",
    "CLC", "VO", "VL", "SP", "EP", "PB", "PP", "CY", "M1", "M3", "ER",
)
_TAG = "(?i)^(" + "|".join(TAGS) + ")(?:[ \\t]{1,3}(.*))?[ \\t]*$"


def tagged_records(files: DataFrame) -> DataFrame:
    """``path, record, tags`` of tagged exports (``path, content``): RT starts a record, ER ends it.

    Lines without a tag continue the tag above; a tag without a value ends it. Records are numbered by a running sum
    per file, values gathered per record.
    """
    lines = files.select("path", F.posexplode(F.split("content", "\\r\\n|\\r|\\n")).alias("line", "raw"))
    tagged = lines.select("path", "line", F.upper(F.regexp_extract("raw", _TAG, 1)).alias("tag"), text.squeeze(F.regexp_extract("raw", _TAG, 2)).alias("value"), text.squeeze(F.col("raw")).alias("raw"))
    by_file = Window.partitionBy("path").orderBy("line")
    t = tagged.withColumn("record", F.sum((F.col("tag") == "RT").cast("int")).over(by_file)).withColumn("field", F.sum((F.col("tag") != "").cast("int")).over(by_file))
    heads = Window.partitionBy("path", "field")
    opened = F.max(F.when(F.col("tag") != "", F.col("value"))).over(heads)
    t = t.withColumn("head", F.max("tag").over(heads)).withColumn("opened", opened).where("record > 0 AND opened <> '' AND head NOT IN ('RT', 'ER', '')")
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("tag") != "", F.col("value")).otherwise(F.col("raw")).alias("v")))), lambda x: x["v"]), " ")
    fields = t.groupBy("path", "record", "field", "head").agg(F.trim(value).alias("value")).where("value <> ''")
    lists = fields.groupBy("path", "record", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "value"))), lambda x: x["value"]).alias("values"))
    return lists.groupBy("path", "record").agg(F.map_from_entries(F.collect_list(F.struct("head", "values"))).alias("tags"))


def _first(*names: str):
    return F.coalesce(*(F.try_element_at(F.try_element_at("tags", F.lit(n)), F.lit(1)) for n in names))


def _many(names: tuple[str, ...], separators: str):
    values = F.flatten(F.array(*(F.coalesce(F.try_element_at("tags", F.lit(n)), F.array().cast("array<string>")) for n in names)))
    return F.array_distinct(F.filter(F.flatten(F.transform(values, lambda v: F.transform(F.split(v, f"[{separators}]"), text.squeeze))), lambda v: v != ""))


def source_records(tagged: DataFrame) -> DataFrame:
    """Candidates from tagged records: the first value of each field's tags, lists split, ids by DOI, URL or content."""
    doi, url = ids.plain_doi(_first("DO", "DI")), ids.canonical_url(_first("UL", "UR", "LK"))
    title, abstract = text.squeeze(_first("T1", "TI")), text.squeeze(_first("AB", "N2"))
    made = F.concat(F.lit("derived:"), F.left(F.sha2(F.concat_ws("|", title, abstract), 256), F.lit(24)))
    rid = F.coalesce(F.nullif(text.squeeze(_first("ID")), F.lit("")), F.when(doi != "", F.concat(F.lit("doi:"), doi)), F.when(url != "", F.concat(F.lit("url:"), url)), made)
    return tagged.select(
        "path",
        "record",
        rid.alias("source_record_id"),
        title.alias("title"),
        abstract.alias("abstract"),
        _many(("A1", "AU"), ";；").alias("authors"),
        _many(("K1", "KW"), ";；,").alias("keywords"),
        text.squeeze(_first("JF", "JO", "T2")).alias("journal"),
        F.nullif(F.regexp_extract(_first("YR", "PY"), "((?:19|20)\\d{2})", 1), F.lit("")).cast("int").alias("publication_year"),
        doi.alias("doi"),
        url.alias("url"),
        F.array_sort(_many(("CL", "CLC"), ";；,")).alias("codes"),
    )


def id_range(docs: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(documents whose id's number lies in the range, missing numbers); ids of other forms are left out."""
    n = F.expr("try_cast(split_part(document_id, '_', 2) AS BIGINT)")
    found = docs.withColumn("number", n).where(F.col("number").between(start, end))
    wanted = docs.sparkSession.range(start, end + 1).withColumnRenamed("id", "number")
    return found, wanted.join(found.select("number"), "number", "left_anti")

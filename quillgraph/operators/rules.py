"""Quality rules of facts: which rules a triple breaks, filters and reports.

Names are compared without white space at their ends, types as they stand; NULL counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from .. import ontology

# Names that are too general for an entity.
GENERIC = (
    "中医", "西医", "中西医", "蒙医", "藏医", "疾病", "症状", "药物", "治疗", "检查", "疗法", "并发症", "患者", "病人", "本病", "该病",
    "该药", "该法", "本书", "本文", "该书", "该文", "文章", "书中", "以上", "以下", "上述",
)
CLINICAL = ("Disease", "Symptom", "Drug", "Treatment", "Examination", "RiskFactor", "Complication", "Department")
SUFFIX_TYPES = tuple(t for t in CLINICAL if t != "Department")
# Endings of disciplines and books, and of titles that name no entity.
DISCIPLINE_ENDS = ("学", "医学", "科学", "辨证", "书", "典", "谱")
TITLE_ENDS = (
    "学", "医学", "中医", "西医", "辨证", "书", "典", "论", "经", "谱", "学报", "杂志", "期刊", "简报", "综述", "指南", "大纲", "概论", "列表",
    "大学", "学院", "医院", "中心", "学部", "研究所", "学会", "基金会",
)
# Syndromes that are no diseases.
SYNDROMES = (
    "表证", "里证", "寒证", "热证", "虚证", "实证", "阴证", "阳证", "表寒证", "表热证", "里寒证", "里热证", "虚寒证", "虚热证", "气虚", "血虚",
    "阴虚", "阳虚", "气血两虚", "阴阳两虚", "八纲辨证", "阴阳辨证", "表里辨证", "寒热辨证", "虚实辨证", "脏腑辨证", "经络辨证", "六经辨证",
    "卫气营血辨证", "三焦辨证",
)
RULES = ("generic", "suffix", "doc_title", "fragment", "review", "tcm_syndrome")


def ends_with(c: Column, ends: tuple[str, ...]) -> Column:
    return c.rlike("(" + "|".join(ends) + ")$")


def broken_rules(triples: DataFrame, titles: DataFrame | None = None, rejects: DataFrame | None = None, rules: tuple[str, ...] = RULES) -> DataFrame:
    """``triples`` with ``broken``, the array of rules that each row breaks, in the order of RULES.

    ``titles``: document_id (unique), title. ``rejects``: id, subject, relation, object, source_document_id of rows
    that people rejected, compared with NULL equal to NULL.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    t = triples
    if titles is not None and "doc_title" in rules:
        names = titles.select(F.col("document_id").alias("_doc"), F.col("title").alias("_title"))
        t = t.join(names, F.col("source_document_id") == F.col("_doc"), "left").drop("_doc")
    else:
        t = t.withColumn("_title", F.lit(None).cast("string"))
    if rejects is not None and "review" in rules:
        keys = ("id", "subject", "relation", "object", "source_document_id")
        r = rejects.select(*(F.col(k).alias("_" + k) for k in keys), F.lit(True).alias("_rejected")).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col("_" + k))
        t = t.join(r, same, "left").drop(*("_" + k for k in keys))
    else:
        t = t.withColumn("_rejected", F.lit(None).cast("boolean"))
    s, o, title = stripped(F.col("subject")), stripped(F.col("object")), F.coalesce(F.col("_title"), F.lit(""))
    st, ot = F.coalesce("subject_type", F.lit("")), F.coalesce("object_type", F.lit(""))
    tests = {
        "generic": (s.isin(*GENERIC) & st.isin(*CLINICAL)) | (o.isin(*GENERIC) & ot.isin(*CLINICAL)),
        "suffix": (s != "") & st.isin(*SUFFIX_TYPES) & ends_with(s, DISCIPLINE_ENDS),
        "doc_title": (s != "") & (s == title) & ends_with(title, TITLE_ENDS),
        "fragment": (ot != "Drug") & F.contains(o, F.lit("、")),
        "review": F.coalesce("_rejected", F.lit(False)),
        "tcm_syndrome": s.isin(*SYNDROMES) & (st == "Disease"),
    }
    broken = F.array_compact(F.array(*(F.when(tests[r], r) for r in RULES if r in rules)))
    return t.withColumn("broken", broken).drop("_title", "_rejected")


def rule_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def query_triples(triples: DataFrame, **equal: str | None) -> DataFrame:
    """Rows equal in all given fields; empty arguments don't filter."""
    for field, value in equal.items():
        if value:
            triples = triples.where(F.col(field) == value)
    return triples


def valid(triples: DataFrame, trimmed: bool = True) -> DataFrame:
    """Rows with subject, relation and object; ``trimmed``: white space alone is empty."""
    for c in ("subject", "relation", "object"):
        triples = triples.where((stripped(F.col(c)) if trimmed else F.coalesce(F.col(c), F.lit(""))) != "")
    return triples


def ontology_valid(triples: DataFrame) -> DataFrame:
    return triples.where(ontology.fits(F.col("relation"), F.col("subject_type"), F.col("object_type")))


def off_topic(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents whose title matches ``pattern``; NULL titles match nothing."""
    return docs.where(F.coalesce(F.col("title").rlike(pattern), F.lit(False)))


def purge(df: DataFrame, removed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows none of whose keys is a removed document_id."""
    ids = removed.select(F.col("document_id").alias("_gone")).where("_gone IS NOT NULL").distinct()
    for k in keys:
        df = df.join(ids, F.col(k) == F.col("_gone"), "left_anti")
    return df


def candidates(flagged: DataFrame) -> DataFrame:
    """The rows of a cleaning report: facts that break a rule, with their rules."""
    cols = ("id", "subject", "subject_type", "relation", "object", "object_type", "source_document_id", "source_text")
    return flagged.where(F.size("broken") > 0).select(*cols, F.col("broken").alias("rules"))

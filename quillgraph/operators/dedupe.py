"""Keep-best and merge operators of facts.

All take a position column where the rule depends on the order of rows; ties never depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology
from ..functions.text import stripped


def _ranked(df: DataFrame, by: list[Column], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_best(triples: DataFrame, keys: tuple[str, ...] = ("subject", "relation", "object")) -> DataFrame:
    """``triples`` with ``action`` keep or delete: of equal stripped keys the highest confidence (NULL as 0), then lowest id."""
    best = _ranked(triples, [stripped(F.col(k)) for k in keys], [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("id")])
    return best.withColumn("action", F.when(F.col("rank") == 1, "keep").otherwise("delete")).drop("rank")


def merge_exact(triples: DataFrame, pos: str = "id") -> DataFrame:
    """First pass: one row per (subject, relation, object, object_type), with ``first_pos`` of the key.

    The highest confidence wins; among equals the last rule-layer row, else the first row. NULL confidence is 0.
    """
    conf = F.coalesce("confidence", F.lit(0.0))
    rule = F.coalesce(F.col("layer") == "rule", F.lit(False))
    keys = [F.col(c) for c in ("subject", "relation", "object", "object_type")]
    w = Window.partitionBy(*keys)
    ranked = _ranked(triples.withColumn("first_pos", F.min(pos).over(w)), keys, [conf.desc(), rule.desc(), F.when(rule, -F.col(pos)).otherwise(F.col(pos))])
    return ranked.where("rank = 1").drop("rank")


def merge_relations(merged: DataFrame) -> DataFrame:
    """Second pass: one row per (subject, object): most specific relation, confidence, other layers before deep_learning, first key."""
    deep = F.coalesce(F.col("layer") == "deep_learning", F.lit(False))
    order = [ontology.specificity(F.col("relation")).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), deep, F.col("first_pos")]
    return _ranked(merged, [F.col("subject"), F.col("object")], order).where("rank = 1").drop("rank")


def merge_layers(triples: DataFrame, pos: str = "id") -> DataFrame:
    return merge_relations(merge_exact(triples, pos)).drop("first_pos")


def first_seen(df: DataFrame, keys: tuple[str, ...], pos: str) -> DataFrame:
    """First row of each key in the order of ``pos``; rows with an empty key field are dropped."""
    for k in keys:
        df = df.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return _ranked(df, [F.col(k) for k in keys], [F.col(pos)]).where("rank = 1").drop("rank")


def capped(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return _ranked(df, [F.col(group)], [F.col(order)]).where(F.col("rank") <= most).drop("rank")


def merge_classifications(items: DataFrame) -> DataFrame:
    """One classification per (document_id, category_id) of rows with ``pos, verified, confidence, code``.

    Fields of the strongest (verified, then confidence, then first), verified if any is, the highest confidence, and
    the different codes in order of arrival.
    """
    strongest = F.struct(F.coalesce("verified", F.lit(False)).alias("v"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("pos")).alias("p"))
    codes = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code"))))
    return items.groupBy("document_id", "category_id").agg(
        F.max_by("basis", strongest).alias("basis"),
        F.bool_or(F.coalesce("verified", F.lit(False))).alias("verified"),
        F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.array_join(F.array_distinct(F.transform(codes, lambda x: x["code"])), "|").alias("codes"),
    )


def new_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known, one per key."""
    return df.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")

"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, label``: the smallest id connected to each id of ``edges`` (a, b). Hot nodes are pre-aggregated map-side."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("hop"))
        step = labels.join(near, "id").join(hop, "label").select("id", F.least("label", "near", "hop").alias("new"), F.col("label").alias("old"))
        step = materialize(step, "labels")
        discard(labels)
        labels = step
        done = step.where("new <> old").isEmpty()
        labels = step.select("id", F.col("new").alias("label"))
        labels.written_path = step.written_path
        if done:
            discard(both)
            return labels
    raise RuntimeError("components did not settle")

"""Incremental runs as streams.

* ``first_arrivals``: of each key the first row, across batches, by Spark's own state.
* ``changed_stream``: every micro-batch of documents against the state table; changed ones go to a handler and the
  state is upserted only after the handler succeeded, so a failed batch is done again.
* ``windowed_counts``: event-time windows with a watermark for late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, store


def first_arrivals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key; NULL is a key value like any other. State grows with the distinct keys."""
    return stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def read_state(spark: SparkSession, path: str, schema: str = "document_id string, content_hash string") -> DataFrame:
    """The newest complete version of the state table; empty if there is none."""
    pointer = _pointer(spark, path)
    return spark.read.schema(schema).parquet(pointer) if pointer else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _pointer(spark: SparkSession, path: str) -> str | None:
    fs, jvm = _fs(spark, path)
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(root):
        return None
    versions = [s.getPath().toString() for s in fs.listStatus(root)]
    done = [v for v in versions if fs.exists(jvm.org.apache.hadoop.fs.Path(v + "/_SUCCESS"))]
    return max(done, key=lambda v: int(v.rsplit("=", 1)[1])) if done else None


def write_state(state: DataFrame, path: str, version: int) -> None:
    """A new version beside the old ones; a version that exists is written again (a batch that was done again)."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def changed_stream(stream: DataFrame, state_path: str, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start the query. Documents need ``document_id, content_hash``; of several rows of one id in a batch the first by hash counts."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        state = read_state(spark, state_path)
        new = store.changed(df, state)
        handle(new, batch_id)
        done = dedupe.first_seen(new.select("document_id", "content_hash"), ("document_id",), "content_hash").where("content_hash IS NOT NULL")
        write_state(store.upsert(state, done, "document_id", ["content_hash"]), state_path, batch_id)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

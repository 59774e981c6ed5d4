"""First-arrival identity of collected records as keyed state.

A record is recognised by any of its keys. Of each source, in order of arrival: no key known - accepted, its keys
stored; one document known with the same content - duplicate, its further keys join that document; another content or
several documents - conflict, nothing stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.components import connected
from ..runtime import materialize

OUT = "source_name string, document_id string, disposition string, matched string"


def decide(known: dict[str, tuple[str, str]], document_id: str, content_hash: str, keys: list[str]) -> tuple[str, str | None]:
    """(disposition, matched document); ``known``: key -> (document_id, content_hash), updated in place."""
    hits = {known[k] for k in keys if k in known}
    if not hits:
        known.update({k: (document_id, content_hash) for k in keys})
        return "accepted", document_id
    if len({d for d, _ in hits}) > 1:
        return "conflict", None
    doc, have = next(iter(hits))
    if have != content_hash:
        return "conflict", doc
    known.update({k: (doc, have) for k in keys if k not in known})
    return "duplicate", doc


def resolve_batch(records: DataFrame, order: str) -> DataFrame:
    """All records in the order of ``order`` (then document_id) within each source.

    Records that share no key, directly or through others, can't affect each other: the rule runs per connected group
    of records and keys, streamed in order through the task that holds the group, with the group's keys in memory.
    """
    rows = records.select("source_name", "document_id", "content_hash", "keys", F.col(order).alias("at"))
    rows = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "identity-rows")
    # a group's edges: each record to its first key, and that key to the record's other keys
    named = F.transform("keys", lambda k: F.concat(F.coalesce("source_name", F.lit("")), F.lit("\x00"), k))
    k = rows.where(F.size("keys") > 0).select("n", F.explode(named).alias("key"), named[0].alias("first"))
    groups = connected(k.select(F.col("first").alias("a"), F.col("key").alias("b")).distinct())
    placed = rows.withColumn("first", F.try_element_at(named, F.lit(1))).join(groups.withColumnRenamed("id", "first"), "first", "left")
    placed = placed.withColumn("label", F.coalesce("label", F.col("n").cast("string"))).drop("first")
    cut = placed.repartition("label").sortWithinPartitions("label", "at", "document_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, known = None, {}
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.label != group:
                    group, known = r.label, {}
                d, m = decide(known, r.document_id, r.content_hash, list(r.keys))
                out.append((r.source_name, r.document_id, d, m))
            yield pd.DataFrame(out, columns=["source_name", "document_id", "disposition", "matched"])

    return cut.mapInPandas(run, OUT)


class IdentityProcessor(StatefulProcessor):
    """The same rule over a stream grouped by source, with the keys in a state map."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "document_id string, content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for b in rows:
            for r in b.itertuples():
                keys = list(r.keys)
                have = {k: tuple(self.known.getValue((k,))) for k in keys if self.known.containsKey((k,))}
                before = set(have)
                d, m = decide(have, r.document_id, r.content_hash, keys)
                for k in have.keys() - before:
                    self.known.updateValue((k,), have[k])
                out.append((key[0], r.document_id, d, m))
        yield pd.DataFrame(out, columns=["source_name", "document_id", "disposition", "matched"])

    def close(self) -> None:
        pass


def resolve_stream(stream: DataFrame) -> DataFrame:
    """Dispositions of a stream of ``source_name, document_id, content_hash, keys``; needs the RocksDB state store."""
    return stream.groupBy("source_name").transformWithStateInPandas(IdentityProcessor(), OUT, "Append", "None")

"""Facts that differ only in how they are written, collapsed with the number of their copies.

Characters, case, white space and punctuation are canonicalized (letters and digits of the consistent form) and the
field order is fixed; for symmetric relations the two ends, each with its type, are ordered too. The canonical tuple
is hashed to 128 bits, counts and first ids are aggregated with map-side combining, and a second, independent hash
checks every group for collisions (a group with two check values raises an error).

A symmetric fact has two keys: *direct* (subject, object, object type) and *pair* (the ends with their types in
either order). Groups are the connected components over both, found on the distinct (direct, pair) keys that meet
more than one partner - a small remainder - by propagating the smallest id until nothing changes.

Defined cases: NULL counts as empty in every field; fully equal rows count as copies; ties have the smallest id as
first; a group of any size needs one aggregated row, rows get their group by a join on the key, which adaptive
execution splits where one key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, finished, materialize
from .canonical import letters_and_digits

FIELDS = ("subject", "subject_type", "relation", "object", "object_type")
# Fixed value: relations whose ends may be exchanged, in letters only.
SYMMETRIC = ("relatedto",)

_OUT = "id long, direct binary, direct_check long, pair binary, pair_check long"


def _hashes(parts: tuple[str, ...]) -> tuple[bytes, int]:
    raw = "\x00".join(parts).encode()
    return hashlib.blake2b(raw, digest_size=16).digest(), int.from_bytes(hashlib.sha1(raw).digest()[:8], "little", signed=True)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[str | None, str] = {}
        cols = []
        for f in FIELDS:
            enc = b.column(f).to_pylist()
            for v in set(enc) - seen.keys():
                seen[v] = letters_and_digits(v)
            cols.append([seen[v] for v in enc])
        direct, dcheck, pair, pcheck = [], [], [], []
        for s, st, r, o, ot in zip(*cols, strict=True):
            h, c = _hashes((r, s, o, ot))
            direct.append(h)
            dcheck.append(c)
            if r in SYMMETRIC:
                h, c = _hashes((r, *min((s, st), (o, ot)), *max((s, st), (o, ot))))
            else:
                h = c = None
            pair.append(h)
            pcheck.append(c)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(direct, pa.binary()), pa.array(dcheck, pa.int64()), pa.array(pair, pa.binary()), pa.array(pcheck, pa.int64())],
            ["id", "direct", "direct_check", "pair", "pair_check"],
        )


def fact_keys(triples: DataFrame) -> DataFrame:
    """``id, direct, direct_check, pair, pair_check`` of every triple; pair is NULL for directed relations."""
    return triples.select(F.col("id").cast("long").alias("id"), *(F.col(f).cast("string").alias(f) for f in FIELDS)).mapInArrow(_keys, _OUT)


def _checked(low, high, key: str):
    return F.when(low == high, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"128-bit collision of {key} "), F.hex(F.col(key)))).cast("boolean"))


def _linked(keys: DataFrame, max_rounds: int) -> DataFrame:
    """``direct, first_id``: smallest id over chains of direct and pair keys, for the chains of two or more directs."""
    edges = keys.where(F.col("pair").isNotNull()).groupBy("direct", "pair").agg(F.min("id").alias("lab"), F.min("pair_check").alias("lo"), F.max("pair_check").alias("hi"))
    ends = edges.groupBy("pair").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where((F.col("n") > 1) & _checked(F.col("lo"), F.col("hi"), "pair")).select("pair")
    touched = edges.join(ends, "pair", "left_semi").select("direct").distinct()
    edges = materialize(edges.join(touched, "direct", "left_semi").select("direct", "pair", "lab"), "fact-edges")
    for _ in range(max_rounds):
        by_direct = edges.groupBy("direct").agg(F.min("lab").alias("d"))
        step = edges.join(by_direct, "direct")
        by_pair = step.groupBy("pair").agg(F.min("d").alias("p"))
        step = materialize(step.join(by_pair, "pair").select("direct", "pair", F.col("p").alias("lab"), "d", (F.col("p") < F.col("lab")).alias("moved")), "fact-labels")
        discard(edges)
        done = step.where("moved").isEmpty()
        edges = step.select("direct", "pair", "lab")
        edges.written_path = step.written_path
        if done:
            return finished(edges.groupBy("direct").agg(F.min("lab").alias("linked")), "linked-facts", edges)
    raise RuntimeError("chains of exchanged facts did not settle")


def fact_groups(triples: DataFrame, max_rounds: int = 50) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(keys of every row, ``direct, first_id, n_copies`` of every direct key, the working tables of both)."""
    keys = materialize(fact_keys(triples), "fact-keys")
    direct = keys.groupBy("direct").agg(F.min("id").alias("own"), F.count("*").alias("n_copies"), F.min("direct_check").alias("lo"), F.max("direct_check").alias("hi"))
    direct = direct.where(_checked(F.col("lo"), F.col("hi"), "direct"))
    linked = _linked(keys, max_rounds)
    groups = direct.join(linked, "direct", "left").select("direct", F.least("own", F.coalesce("linked", "own")).alias("first_id"), "n_copies", (F.col("linked") < F.col("own")).alias("joined"))
    return keys, groups, (keys, linked)


def duplicate_facts(triples: DataFrame) -> DataFrame:
    """``first_id, id`` of each triple that repeats an earlier one."""
    keys, groups, used = fact_groups(triples)
    # keys with one row that join no other need not meet the rows again
    groups = groups.where((F.col("n_copies") > 1) | F.coalesce("joined", F.lit(False))).select("direct", "first_id")
    return finished(keys.select("id", "direct").join(groups, "direct").where("id <> first_id").select("first_id", "id"), "repeated-facts", *used)


def unique_facts(triples: DataFrame) -> DataFrame:
    """One triple per fact (that of the smallest id) with its number of copies."""
    _, groups, used = fact_groups(triples)
    counts = finished(groups.groupBy("first_id").agg(F.sum("n_copies").alias("n_copies")), "fact-copies", *used)
    firsts = triples.select(F.col("id").alias("first_id"), *FIELDS)
    return firsts.join(counts, "first_id").select(F.col("first_id").alias("id"), *FIELDS, "n_copies")

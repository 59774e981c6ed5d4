"""Mixing sources to target weights.

Every source gives its target share of all tokens; a document is used at most its source's ``max_repeats`` times.
The total is the largest for which each source with documents can give its share: the smallest of
``max_repeats * tokens / share``. A source passes over its documents in a fixed pseudo-random order as often as it has
to, the last pass ending at the document whose middle lies nearest its share.

The mix is interleaved by Pfair scheduling: each source's stream is cut into blocks of equal tokens, block ``j`` of a
source of weight ``w`` is released at ``floor(j / w)`` and due by ``ceil((j + 1) / w)``, and each slot takes the released
block with the earliest deadline, so after any slot every source is less than one block from its weight. Blocks cover
all passes: ``scheduled`` gives every use of a document its slot, ``mixed`` the slot of the first.

A block is never smaller than the largest document, which belongs to the block it begins in, so what the rows of the
first slots hold is less than two blocks from every source's weight.

Prefix sums over a source's documents are two-level (sums of hash buckets of some ``bucket_rows`` documents, then within
a bucket), so a source that holds most rows is spread over all tasks. The schedule has ``blocks`` rows at most.

Defined cases: documents with NULL source, or of a source that is not in the mix, belong to none; NULL and empty texts
have no tokens and are not chosen; a source without documents gives nothing (the others keep their proportions) and
is reported with actual share 0; a share that is NULL or 0 takes nothing; repeated source rows are an error.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import finished, materialize
from .bpe import DEFAULT_VOCABULARY, count_tokens

MOST_SOURCES = 10_000


def pfair_schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block number) of each slot. Weights are the sources' shares of the blocks."""
    total = sum(blocks.values())
    weight = {s: Fraction(n, total) for s, n in blocks.items() if n}
    release = lambda s, j: j * weight[s].denominator // weight[s].numerator
    due = lambda s, j: -(-(j + 1) * weight[s].denominator // weight[s].numerator)
    waiting = [(0, due(s, 0), s, 0) for s in sorted(weight)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, d, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (d, s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, j + 1), due(s, j + 1), s, j + 1))
    return out


def token_sizes(docs: DataFrame, mix: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents of the mix that have tokens."""
    src = docs.select("doc_id", "source", F.col("text").cast("string").alias("text")).where("text <> ''")
    src = src.join(mix.select("source").distinct(), "source", "left_semi")
    return count_tokens(src, ["doc_id", "source"], "text", vocabulary)


def plan(totals: dict[str, int], mix: list[tuple[str, float, int]]) -> dict[str, dict]:
    """Per source its need in tokens, whole passes and the tokens of the last pass."""
    if len({s for s, _, _ in mix}) < len(mix):
        raise ValueError("a source occurs twice in the mix")
    live = [(s, share, reps) for s, share, reps in mix if share and share > 0 and reps and reps > 0 and totals.get(s)]
    total = min((reps * totals[s] / share for s, share, reps in live), default=0.0)
    out = {}
    for s, share, reps in live:
        need = min(int(round(share * total)), reps * totals[s])
        passes = need // totals[s]
        out[s] = {"tokens": totals[s], "need": need, "passes": passes, "rest": need - passes * totals[s], "most": reps}
    return out


def _chosen(docs: DataFrame, mix: DataFrame, vocabulary: str, blocks: int, bucket_rows: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen documents with their places in the first pass, the slot of each source's blocks, and the working table."""
    spark = docs.sparkSession
    rows = mix.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source IS NOT NULL").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    sizes = materialize(token_sizes(docs, mix, vocabulary), "token-sizes")
    # one row per source of the mix
    found = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most"), F.count("*").alias("docs")).collect()
    totals = {r.source: r.n for r in found}
    buckets = max(1, -(-max((r.docs for r in found), default=0) // bucket_rows))
    plans = plan(totals, [(r.source, r.target_share, r.max_repeats) for r in rows])
    schema = "source string, tokens long, passes long, rest long, block double"
    total = sum(p["need"] for p in plans.values())
    size = max(1.0, total / blocks, *(float(r.most) for r in found if r.source in plans))
    per_source = spark.createDataFrame([(s, p["tokens"], p["passes"], p["rest"], size) for s, p in plans.items()], schema)
    counts = {s: max(1, round(p["need"] / size)) for s, p in plans.items()}
    slots = spark.createDataFrame([(s, j, t) for t, (s, j) in enumerate(pfair_schedule(counts))], "source string, block_no long, slot long")
    order = F.xxhash64("doc_id", F.lit(seed))
    d = sizes.join(F.broadcast(per_source), "source").withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["source", "bucket"])
    start = F.col("before") + F.col("within")
    d = d.withColumn("start", start).withColumn("repeats", (F.col("passes") + F.when(F.col("start") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).cast("int"))
    ends = spark.createDataFrame([(s, n - 1) for s, n in counts.items()], "source string, last long")
    return d.where("repeats > 0").join(F.broadcast(ends), "source"), slots, sizes


def _in_slots(uses: DataFrame, slots: DataFrame) -> DataFrame:
    """``uses`` with the slot of the block that holds their ``place``."""
    block = F.least(F.greatest(F.lit(0), F.floor(F.col("place") / F.col("block"))), F.col("last"))
    return uses.withColumn("block_no", block).join(F.broadcast(slots), ["source", "block_no"])


def mixed(docs: DataFrame, mix: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, blocks: int = 8192, bucket_rows: int = 50_000, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, repeats, first_slot`` of the chosen documents."""
    d, slots, sizes = _chosen(docs, mix, vocabulary, blocks, bucket_rows, seed)
    chosen = _in_slots(d.withColumn("place", F.col("start")), slots).select("doc_id", "source", "n_tokens", "repeats", F.col("slot").alias("first_slot"))
    return finished(chosen, "mix", sizes)


def scheduled(docs: DataFrame, mix: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, blocks: int = 8192, bucket_rows: int = 50_000, seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, use, slot`` of every use of the chosen documents, ``max_repeats`` rows at most each.

    Use ``k`` lies ``k - 1`` whole passes over its source behind the first.
    """
    d, slots, sizes = _chosen(docs, mix, vocabulary, blocks, bucket_rows, seed)
    uses = d.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("repeats")))).withColumn("place", F.col("start") + (F.col("use") - 1) * F.col("tokens"))
    return finished(_in_slots(uses, slots).select("doc_id", "source", "n_tokens", "use", "slot"), "schedule", sizes)


def shares(chosen: DataFrame, mix: DataFrame) -> DataFrame:
    """Per source of the mix: documents, tokens with repeats, target and actual share."""
    by = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    out = mix.select("source", "target_share", "max_repeats").join(by, "source", "left").fillna(0, ["n_docs", "n_tokens", "most_repeats"])
    total = out.groupBy().agg(F.sum("n_tokens").alias("all_tokens"))
    # one row of totals
    return out.join(F.broadcast(total)).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "most_repeats", F.when(F.col("all_tokens") > 0, F.col("n_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"))

"""Byte-level BPE of a public vocabulary by a pair occurrence index.

All distinct pre-tokens of a chunk lie in one byte sequence with links to neighbours. An index maps each mergeable
pair (by its rank) to all its positions in the chunk; active ranks are applied in ascending order, each to all of its
positions at once, and the lists of the pairs that appear beside a merge are updated. A merge only makes pairs of
later ranks, so one ascending pass is the whole encoding.

Defined cases: NULL and empty texts give an empty list; special tokens' strings are ordinary text; a text of any
length is encoded whole (it may fill a chunk of its own). The vocabulary (some 50,000 merges, a bounded file) is read
on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pre-token pattern of the vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
CHUNK_BYTES = 4_000_000
#: Up to so many positions are merged one by one: array calls cost more there.
FEW = 8


def printable_bytes() -> dict[int, str]:
    """The vocabulary files write each byte as a printable character: itself, or the next free one from 256 on."""
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    free = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(free)) for b in range(256)}


class Merges:
    """Merges of a vocabulary file as sorted arrays."""

    def __init__(self, parts: dict):
        vars(self).update(parts)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        left, right, new = [], [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            left.append(ids[a])
            right.append(ids[b])
            new.append(ids[a + b])
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(key)
        shown = printable_bytes()
        return cls(
            {
                "key": key[order],
                "rank": order.astype(np.int32),
                "new": np.array(new, np.int32),
                "twin": np.array(left) == np.array(right),
                "table": dict(zip(key.tolist(), range(len(key)), strict=True)),
                "byte_ids": np.array([ids[shown[b]] for b in range(256)], np.int32),
            }
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], NONE)


def encode_pieces(pieces: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, number of ids of each piece)."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(lens.sum())
    tok = m.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(lens)
    nxt[ends - 1] = -1
    prv[ends - lens] = -1
    alive = np.ones(n, bool)
    at = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(nxt >= 0).astype(np.int32)
    at[inner] = m.ranks(tok[inner], tok[inner + 1])
    # the index: positions by rank, as slices of one array at first, as lists of arrays for pairs that appear later
    order = inner[np.argsort(at[inner], kind="stable")]
    sorted_ranks = at[order]
    cut = np.searchsorted(sorted_ranks, NONE)
    order, sorted_ranks = order[:cut].astype(np.int32), sorted_ranks[:cut]
    firsts = np.flatnonzero(np.diff(sorted_ranks, prepend=-1))
    index: dict[int, list[np.ndarray]] = {int(sorted_ranks[a]): [order[a:b]] for a, b in zip(firsts, [*firsts[1:], cut], strict=True)} if cut else {}
    active = list(index)  # ascending, so a heap
    table = m.table
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        pos = pos[at[pos] == r]  # pairs that have gone since
        if not len(pos):
            continue
        if m.twin[r] and len(pos) > FEW:
            # in a run of equal tokens every other pair from the left
            start = np.ones(len(pos), bool)
            start[1:] = nxt[pos[:-1]] != pos[1:]
            k = np.arange(len(pos))
            pos = pos[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
        if len(pos) <= FEW:
            for p in pos.tolist():
                if at[p] != r:
                    continue
                g = int(nxt[p])
                a = int(nxt[g])
                tok[p], alive[g], at[g], nxt[p], at[p] = m.new[r], False, NONE, a, NONE
                places = []
                if a >= 0:
                    prv[a] = p
                    places.append((p, int(tok[p]), int(tok[a])))
                if (b := int(prv[p])) >= 0:
                    places.append((b, int(tok[b]), int(tok[p])))
                for place, x, y in places:
                    q = table.get(x << 32 | y)
                    if q is None:
                        at[place] = NONE
                        continue
                    at[place] = q
                    if q in index:
                        index[q].append(np.array([place], np.int32))
                    else:
                        index[q] = [np.array([place], np.int32)]
                        heapq.heappush(active, q)
            continue
        gone = nxt[pos]
        after = nxt[gone]
        tok[pos] = m.new[r]
        alive[gone] = False
        at[gone] = NONE
        nxt[pos] = after
        inside = after >= 0
        prv[after[inside]] = pos[inside]
        at[pos[~inside]] = NONE
        before = prv[pos]
        changed = np.concatenate((pos[inside], before[before >= 0]))
        ranks = m.ranks(tok[changed], tok[nxt[changed]])
        at[changed] = ranks
        live = ranks != NONE
        changed, ranks = changed[live], ranks[live]
        if len(ranks):
            o = np.lexsort((changed, ranks))
            changed, ranks = changed[o], ranks[o]
            once = np.diff(changed, prepend=-1) != 0  # a place between two merges comes twice
            changed, ranks = changed[once], ranks[once]
            f = np.flatnonzero(np.diff(ranks, prepend=-1))
            for a, b in zip(f.tolist(), [*f[1:].tolist(), len(ranks)], strict=True):
                q = int(ranks[a])
                if q in index:
                    index[q].append(changed[a:b])
                else:
                    index[q] = [changed[a:b]]
                    heapq.heappush(active, q)
    counts = np.add.reduceat(alive, ends - lens, dtype=np.int64) if len(pieces) else lens
    return tok[alive], counts


def encode_texts(texts: list[str | None], m: Merges, pattern: regex.Pattern) -> pa.ListArray:
    """Lists of ids of the texts."""
    known: dict[str, int] = {}
    which: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = pattern.findall(t)
            sizes[i] = len(found)
            which.extend([known.setdefault(p, len(known)) for p in found])
    if not known:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
    ids, counts = encode_pieces([p.encode() for p in known], m)
    starts = np.cumsum(counts) - counts
    w = np.array(which, np.int64)
    n = counts[w]
    ends = np.cumsum(n)
    flat = ids[np.repeat(starts[w] - (ends - n), n) + np.arange(int(ends[-1]))]
    offsets = np.concatenate(([0], np.concatenate(([0], ends))[np.cumsum(sizes)]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def _chunks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        # three bytes a character at most but for rare signs
        n = 3 * len(t) if t else 0
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    yield a, len(texts)


#: Broadcasts of this process by application and vocabulary: one each, however many queries encode.
_SHARED: dict[tuple[str, str], Broadcast] = {}


def _shared(spark: SparkSession, vocabulary: str) -> Broadcast:
    """The vocabulary's parts as plain arrays and a dict, which workers read without this package."""
    sc = spark.sparkContext
    at = (sc.applicationId, vocabulary)
    if at not in _SHARED:
        _SHARED[at] = sc.broadcast(vars(Merges.load(vocabulary)))
    return _SHARED[at]


def _mapped(df: DataFrame, keys: list[str], text: str, vocabulary: str, chunk_bytes: int, out: str, finish) -> DataFrame:
    shared = _shared(df.sparkSession, vocabulary)
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pattern = Merges(shared.value), regex.compile(PRE_TOKEN)
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            for a, z in _chunks(texts, chunk_bytes):
                if z > a:
                    made = finish(encode_texts(texts[a:z], m, pattern))
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, z - a) for i in range(len(keys))), made], [*names, "v"])

    src = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(text).cast("string").alias("t"))
    schema = ", ".join(f"{n} {kinds[k]}" for k, n in zip(keys, names, strict=True)) + f", v {out}"
    return src.mapInArrow(run, schema).toDF(*keys, "v")


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``key, ids`` of every row of ``df``: the text's ids without special tokens."""
    return _mapped(df, [key], text, vocabulary, chunk_bytes, "array<int>", lambda lists: lists).withColumnRenamed("v", "ids")


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary: str = DEFAULT_VOCABULARY, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``keys.., n_tokens`` of every row of ``df``."""
    return _mapped(df, keys, text, vocabulary, chunk_bytes, "long", lambda lists: lists.value_lengths().cast(pa.int64())).withColumnRenamed("v", "n_tokens")

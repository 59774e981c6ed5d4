"""Groups of records that share most of their content.

Contents are compared by the Jaccard similarity of their distinct runs of ``width`` characters, letters and digits of
the consistent form only. The steps:

1. *signatures* (one Arrow pass): MinHash values, folded into an *odd sketch* - a parity bitmap in which every value
   flips one bit, so the XOR of two bitmaps has a population count that estimates high similarities precisely - and
   combined into band keys; a 128-bit hash of the compared text. Exact copies collapse to their smallest id first.
2. *banded candidates without all pairs*: every bucket's members meet the bucket's first member only; pairs whose
   sketches are near are verified exactly; verified pairs give components.
3. *the rest*: buckets whose members still belong to several components give the pairs across those components (and
   none within), by joins on (bucket, component); the same sketch and exact check follow, so no link between texts
   that share a band is lost, and a bucket that is one large group costs one pair per member.
4. *hot buckets*: where more than ``most_pairs`` pairs would lie across a bucket's components (a band of boilerplate in
   unrelated texts), its members meet by their rare runs instead: of a text with n distinct runs the n - ceil(t n) + 1
   rarest ones; two texts of similarity t or more share one of these, so nothing is lost, and unrelated texts share
   only what is common and therefore not among them.

Groups come from min-label propagation with pointer jumping over the verified links. Nothing is collected: all steps
are joins and aggregations that partition by key, with hot keys pre-aggregated or split by adaptive execution.

Defined cases: NULL texts, and texts with fewer than ``min_chars`` compared characters, belong to no group; equal
texts are one group however many there are; ties need no rule, a group is named by its smallest id; whole texts of
any length count; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from ..runtime import discard, materialize
from .canonical import letters_and_digits


@dataclass(frozen=True)
class Scheme:
    """Shingle width, least length, threshold, and the shape of bands and sketches."""

    width: int = 5
    min_chars: int = 60
    threshold: float = 0.6
    bands: int = 48
    rows: int = 5
    words: int = 8  # 64-bit words of the odd sketch
    slack: float = 0.2  # how far an estimate may lie under the threshold and still be verified
    most_pairs: int = 20_000  # pairs of one bucket that are formed directly; beyond, rare shingles select them
    seed: int = 20240607

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def most_flips(self) -> int:
        """Population count of the XOR at the least similarity to verify: m/2 (1 - exp(-4k(1-J)/m))."""
        m = 64 * self.words
        return int(np.ceil(m / 2 * (1 - np.exp(-4 * self.hashes * (1 - self.threshold + self.slack) / m))))


WINDOWS = 1 << 18  # shingles hashed at a time: temporary arrays stay in cache


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Signer:
    """MinHash band keys and odd sketches of texts."""

    def __init__(self, scheme: Scheme):
        self.scheme = s = scheme
        rng = np.random.default_rng(s.seed)
        self.mul = rng.integers(0, 1 << 31, s.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 1 << 32, s.hashes, dtype=np.uint32)
        self.roll = rng.integers(0, 1 << 63, s.width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(0, 1 << 31, s.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def sign(self, keys: list[str], which: range | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(band keys [n, bands] int64, sketches [n, words] int64) of texts of at least ``width`` characters.

        ``which`` limits the bands; sketches are whole only with all of them."""
        s = self.scheme
        which = range(s.bands) if which is None else which
        n = len(keys)
        bands = np.empty((n, len(which)), np.uint64)
        sketch = np.zeros((n, s.words), np.uint64)
        a = 0
        while a < n:
            z, size = a, 0
            while z < n and (z == a or size + len(keys[z]) <= WINDOWS):
                size += len(keys[z])
                z += 1
            self._chunk(keys[a:z], bands[a:z], sketch[a:z], which)
            a = z
        return bands.view(np.int64), sketch.view(np.int64)

    def hashed(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit hashes of all shingles one after another, number of shingles of each text)."""
        s = self.scheme
        lens = np.fromiter(map(len, keys), np.int64, len(keys))
        cp = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(len(cp) - s.width + 1, np.uint64)
        for i in range(s.width):
            h += cp[i : len(cp) - s.width + 1 + i] * self.roll[i]
        inside = np.ones(len(cp), bool)
        ends = np.cumsum(lens)
        for i in range(1, s.width):
            inside[ends - i] = False
        return _mix(h[inside[: len(h)]]), lens - s.width + 1

    def pivot_table(self, keys: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of distinct shingles, [n, words] bitmaps of the hash classes that have a shingle of the text)."""
        size = np.empty(len(keys), np.int32)
        table = np.zeros((len(keys), words), np.uint64)
        a = 0
        while a < len(keys):
            z, n = a, 0
            while z < len(keys) and (z == a or n + len(keys[z]) <= WINDOWS):
                n += len(keys[z])
                z += 1
            x, lens = self.hashed(keys[a:z])
            row = np.repeat(np.arange(z - a), lens)
            o = np.lexsort((x, row))
            x, row = x[o], row[o]
            once = np.ones(len(x), bool)
            once[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
            x, row = x[once], row[once]
            size[a:z] = np.bincount(row, minlength=z - a)
            place = np.unique(row * (64 * words) + (x % np.uint64(64 * words)).astype(np.int64))
            word = place >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), first)
            table[a:z].reshape(-1)[word[first]] = bits
            a = z
        return size, table.view(np.int64)

    def _chunk(self, keys: list[str], bands: np.ndarray, sketch: np.ndarray, which: range) -> None:
        s = self.scheme
        h, lens = self.hashed(keys)
        x = (h >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(lens) - lens
        rows = np.arange(len(keys))
        v = np.empty_like(x)
        for i, b in enumerate(which):
            key = np.full(len(keys), b + 1, np.uint64)
            for j in range(b * s.rows, (b + 1) * s.rows):
                np.bitwise_xor(x, self.xor[j], out=v)
                np.multiply(v, self.mul[j], out=v)
                low = np.minimum.reduceat(v, starts)
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
                if not s.words:
                    continue
                # the bit this value flips: a hash of the value and of its place among the values
                at = _mix(low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + self.place[j]) % np.uint64(64 * s.words)
                sketch[rows, (at >> np.uint64(6)).astype(np.intp)] ^= np.uint64(1) << (at & np.uint64(63))
            bands[:, i] = key


def shingles(key: str, width: int) -> set[str]:
    return {key[i : i + width] for i in range(len(key) - width + 1)}


def similarity(a: str, b: str, width: int) -> float:
    """Exact Jaccard similarity of two compared texts."""
    x, y = shingles(a, width), shingles(b, width)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def signatures(df: DataFrame, key: str, text: str, scheme: Scheme, pivots: int = 0, with_bands: bool = True) -> DataFrame:
    """``id, compared, hash, bands, s0..`` of the rows with enough compared characters; with ``pivots`` also ``n, q0..``,
    that many words of the pivot table. Bands are more than half of the bytes; without them ``band_slices`` makes them of
    ``compared``, a slice at a time."""
    kind = dict(df.dtypes)[key]
    words = [f"s{i}" for i in range(scheme.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(scheme)
        for b in batches:
            keys = [letters_and_digits(t) for t in b.column("t").to_pylist()]
            keep = [i for i, k in enumerate(keys) if len(k) >= max(scheme.min_chars, scheme.width)]
            if not keep:
                continue
            keys = [keys[i] for i in keep]
            bands, sketch = signer.sign(keys, None if with_bands or scheme.words else range(0))
            hashes = [hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * scheme.bands), pa.array(bands.ravel()))] if with_bands else []
            ids = b.column("id").take(pa.array(keep, pa.int64()))
            cols = [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(scheme.words)]
            if pivots:
                size, table = signer.pivot_table(keys, pivots)
                cols += [pa.array(size), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(pivots))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(hashes, pa.binary()), *lists, *cols], names)

    extra = ["n", *(f"q{i}" for i in range(pivots))] if pivots else []
    names = ["id", "compared", "hash", *["bands"] * with_bands, *words, *extra]
    longs = "".join(f", {w} long" for w in words)
    schema = f"id {kind}, compared string, hash binary{', bands array<long>' * with_bands}{longs}" + (", n int" + "".join(f", q{i} long" for i in range(pivots)) if pivots else "")
    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").mapInArrow(run, schema)


@dataclass(frozen=True)
class Near:
    """What tells that a pair can't reach the threshold: columns of both tables by id, and the test of a pair's columns."""

    left: DataFrame
    right: DataFrame
    columns: tuple[str, ...]
    test: Callable[[str, str], Column]
    texts: int  # rows of the signed tables, to which the slices are bounded

    def side(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the columns of its id ``name``."""
        of = self.left if name == "a" else self.right
        return rows.join(of.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in self.columns)), name)

    def slices(self, rows: int) -> int:
        """So many parts that one holds at most ``ROWS_A_TEXT`` rows a text (of small tables ``LEAST_ROWS``), however
        buckets grow with the table."""
        return max(1, -(-rows // max(LEAST_ROWS, ROWS_A_TEXT * self.texts)))

    def stars(self, left: DataFrame, right: DataFrame, rows: int, tag: str) -> DataFrame:
        """Near pairs ``a, b`` of ``left`` and ``right``, of which one has a row a bucket: pairs are as many as rows."""
        def part(x, y):
            return self.side(self.side(x.join(y, "bucket").select("a", "b").distinct(), "a"), "b").where(self.test("a", "b")).select("a", "b")

        return self._sliced(left, right, self.slices(rows), tag, part)

    def meet(self, left: DataFrame, right: DataFrame, rows: int, tag: str, also: Column | None = None) -> DataFrame:
        """Near pairs ``a, b`` that share a bucket. Rows bring their columns to the bucket and pairs are tested where
        they meet, so far ones are never written, however many there are."""
        def part(x, y):
            pairs = self.side(x, "a").join(self.side(y, "b"), "bucket").where(self.test("a", "b"))
            return (pairs if also is None else pairs.where(also)).select("a", "b").distinct()

        return self._sliced(left, right, self.slices(rows), tag, part)

    @staticmethod
    def _sliced(left: DataFrame, right: DataFrame, parts: int, tag: str, part: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        of = lambda df, k: df if parts == 1 else df.where(F.pmod(F.xxhash64("bucket"), F.lit(parts)) == k)
        return written([materialize(part(of(left, k), of(right, k)), tag) for k in range(parts)])


#: Rows of a bucket table a text that are shuffled at a time, with their sketches or pivots.
ROWS_A_TEXT = 8
LEAST_ROWS = 500_000


def written(tables: list[DataFrame]) -> DataFrame:
    """The union of written tables; its ``parts`` are to be discarded."""
    out = reduce(DataFrame.union, tables)
    out.parts = tables
    return out


def sketch_near(signed: DataFrame, scheme: Scheme) -> Near:
    """The odd sketches allow the threshold."""
    words = tuple(f"s{i}" for i in range(scheme.words))
    flips = lambda a, b: reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{a}_{w}").bitwiseXOR(F.col(f"{b}_{w}"))) for w in words))
    return Near(signed, signed, words, lambda a, b: flips(a, b) <= scheme.most_flips, signed.count())


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, scheme: Scheme) -> DataFrame:
    """Of pairs ``a, b`` those whose exact similarity reaches the threshold, by the whole compared texts."""
    x = left.select(F.col("id").alias("a"), F.col("compared").alias("x"))
    y = right.select(F.col("id").alias("b"), F.col("compared").alias("y"))
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(p, q, scheme.width) >= scheme.threshold for p, q in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok, pa.bool_())), b.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


#: Bands are exploded and shuffled in so many slices; a bucket lies in one of them.
BAND_SLICES = 2


def band_source(signed: DataFrame) -> str:
    """The column that ``band_slices`` makes bands of."""
    return "bands" if "bands" in signed.columns else "compared"


def band_slices(rows: DataFrame, scheme: Scheme, *kept: str) -> list[DataFrame]:
    """``kept, bucket`` of the rows' bands, one table a slice of bands. Rows signed without bands get those of the slice
    when it is read, so all bands are never written."""
    n = -(-scheme.bands // BAND_SLICES)
    if band_source(rows) == "bands":
        return [rows.select(*kept, F.explode(F.slice("bands", k + 1, n)).alias("bucket")) for k in range(0, scheme.bands, n)]
    return [_signed_slice(rows, scheme, range(k, min(k + n, scheme.bands)), *kept) for k in range(0, scheme.bands, n)]


def _signed_slice(rows: DataFrame, scheme: Scheme, which: range, *kept: str) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(scheme)
        for b in batches:
            bands, _ = signer.sign(b.column("compared").to_pylist(), which)
            at = pa.array(np.repeat(np.arange(len(bands)), len(which)))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in kept), pa.array(bands.ravel())], [*kept, "bucket"])

    return rows.select(*kept, "compared").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "bucket long"]))


def bucket_members(signed: DataFrame, scheme: Scheme) -> DataFrame:
    """``bucket, id, lead`` of the buckets with two members or more; the lead is the smallest."""
    out = []
    for rows in band_slices(signed, scheme, "id"):
        leads = rows.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("bucket", "lead")
        out.append(materialize(rows.join(leads, "bucket"), "bucket-members"))
    return written(out)


#: Classes of shingles by hash, of which the occurrences are counted: a table of fixed size.
CLASSES = 1 << 18


def shingle_counts(texts: DataFrame, scheme: Scheme) -> np.ndarray:
    """Occurrences of the shingles of each class in ``texts`` (id, compared), a text's own counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, n = Signer(scheme), np.zeros(CLASSES, np.int64)
        for b in batches:
            for k in b.column("compared").to_pylist():
                n += np.bincount(_class(np.unique(signer.hashed([k])[0])), minlength=CLASSES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["c", "n"])

    rows = texts.select("compared").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES rows
    out = np.zeros(CLASSES, np.int64)
    out[rows.column("c").to_numpy()] = rows.column("n").to_numpy()
    return out


def _class(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def rare_shingles(texts: DataFrame, scheme: Scheme, counts: np.ndarray, part: int = 0, parts: int = 1) -> DataFrame:
    """``side, id, bucket`` of ``texts`` (side, id, compared): the rarest shingles of every text, as buckets that hold
    two rows or more; of ``parts`` slices by hash the one of number ``part``.

    Shingles are ordered by the occurrences of their class, then by hash; of n distinct ones the first n - ceil(t n) + 1
    are given. Texts of similarity t share at least one of these, whatever the order is, so the counts of classes lose
    nothing. Hashes may collide, which only adds candidates. All shingles are never written, and a slice at a time is.
    """
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(scheme)
        for b in batches:
            rare = []
            for k in b.column("compared").to_pylist():
                h = np.unique(signer.hashed([k])[0])
                n = counts[_class(h)]
                first = np.argsort(n, kind="stable")[: len(h) - int(np.ceil(len(h) * scheme.threshold - 1e-9)) + 1]
                h = h[first[n[first] > 1]]  # what occurs once meets nothing
                rare.append(h[h % np.uint64(parts) == part])
            rows = pa.array(np.repeat(np.arange(len(rare)), [len(h) for h in rare]))
            h = np.concatenate(rare).view(np.int64) if rare else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("side").take(rows), b.column("id").take(rows), pa.array(h)], ["side", "id", "bucket"])

    rows = texts.select("side", "id", "compared").mapInArrow(run, f"side int, id {kind}, bucket long")
    twice = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return materialize(rows.join(twice, "bucket").select("side", "id", "bucket"), "rare-shingles")


def _by_rare(texts: DataFrame, scheme: Scheme, near: Near | None, meet: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """What ``meet`` makes of the rare shingles of ``texts`` (side, id, compared), slice by slice."""
    counts = shingle_counts(texts, scheme)
    parts = near.slices(int(counts.sum() * (1 - scheme.threshold)) // 3) if near else 1  # a row has a third of the bytes
    out = []
    for k in range(parts):
        rare = rare_shingles(texts, scheme, counts, k, parts)
        out.append(meet(rare))
        if near:
            discard(rare)
    return out


def bucket_pairs(left: DataFrame, right: DataFrame, left_texts: DataFrame, right_texts: DataFrame, scheme: Scheme, near: Near | None = None, also: Column | None = None) -> DataFrame:
    """Different pairs ``a, b`` of ``left`` (bucket, a) and ``right`` (bucket, b); hot buckets' members by rare shingles.

    With ``near`` the pairs that it allows, written in slices; ``also`` is one more condition on a and b.
    """
    n = left.groupBy("bucket").agg(F.count("*").alias("n_a")).join(right.groupBy("bucket").agg(F.count("*").alias("n_b")), "bucket")
    n = materialize(n.withColumn("hot", F.col("n_a").cast("double") * F.col("n_b") > scheme.most_pairs), "bucket-sizes")

    def pairs(x: DataFrame, y: DataFrame, rows: Callable[[], int], tag: str) -> DataFrame:
        if near:
            return near.meet(x, y, rows(), tag, also)
        both = x.join(y, "bucket")
        return (both if also is None else both.where(also)).select("a", "b").distinct()

    cool = n.where("NOT hot").select("bucket") if near else n.where("hot").select("bucket")
    how = "left_semi" if near else "left_anti"
    out = [pairs(left.join(cool, "bucket", how), right.join(cool, "bucket", how) if near else right, lambda: int(n.where("NOT hot").agg(F.coalesce(F.sum(F.col("n_a") + F.col("n_b")), F.lit(0))).first()[0]), "bucket-near")]
    hot = n.where("hot").select("bucket")
    if not hot.isEmpty():
        x = left.join(hot, "bucket", "left_semi").select(F.col("a").alias("id")).distinct().join(left_texts, "id")
        y = right.join(hot, "bucket", "left_semi").select(F.col("b").alias("id")).distinct().join(right_texts, "id")
        side = lambda df, k: df.select(F.lit(k).alias("side"), "id", "compared")
        texts = materialize(side(x, 0).unionByName(side(y, 1)), "hot-texts")
        of = lambda rare, k, name: rare.where(F.col("side") == k).select("bucket", F.col("id").alias(name))
        out += _by_rare(texts, scheme, near, lambda rare: pairs(of(rare, 0, "a"), of(rare, 1, "b"), rare.count, "rare-near"))
        if near:
            discard(texts)
    if not near:
        return reduce(DataFrame.union, out).distinct()
    discard(n)
    return written([t for o in out for t in o.parts])


def _across(m: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``m`` (bucket, id, label) that share a bucket and have different labels."""
    c = m.select("bucket", "label").distinct()
    across = c.alias("p").join(c.alias("q"), "bucket").where("p.label < q.label").select("bucket", F.col("p.label").alias("lo"), F.col("q.label").alias("hi"))
    left = m.select("bucket", F.col("label").alias("lo"), F.col("id").alias("x"))
    right = m.select("bucket", F.col("label").alias("hi"), F.col("id").alias("y"))
    pairs = across.join(left, ["bucket", "lo"]).join(right, ["bucket", "hi"])
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cross_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, scheme: Scheme, near: Near | None = None) -> DataFrame:
    """Pairs ``a, b`` that share a bucket and belong to different components, none with its bucket's lead.

    The components of a bucket are listed first; members then join by (bucket, component), so pairs within one
    component are never formed. Members of hot buckets meet by their rare shingles in the same way. With ``near`` the
    pairs that it allows, written in slices: members of buckets whose pairs, those within components included, are no
    more than ``most_pairs`` are tested where they meet.
    """
    m = members.where("id <> lead").join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    by_label = m.groupBy("bucket", "label").agg(F.count("*").cast("double").alias("n"))
    n = by_label.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    n = n.withColumn("pairs", (F.col("n") * F.col("n") - F.col("within")) / 2).where("pairs > 0")
    n = n.select("bucket", (F.col("pairs") > scheme.most_pairs).alias("hot"), (F.col("n") * F.col("n") / 2 <= scheme.most_pairs).alias("small"))
    m = materialize(m.join(n, "bucket"), "mixed-buckets")
    hot = materialize(m.where("hot").select("id", "label").distinct(), "hot-members")
    side = lambda: materialize(hot.join(texts, "id").select(F.lit(0).alias("side"), "id", "compared"), "hot-texts")
    if near is None:
        pairs = _across(m.where("NOT hot"))
        if not hot.isEmpty():
            pairs = reduce(DataFrame.union, _by_rare(side(), scheme, None, lambda rare: _across(rare.join(hot, "id").select("bucket", "id", "label"))), pairs)
        return pairs.distinct()

    def meet(rows: DataFrame, tag: str) -> DataFrame:
        of = lambda k: rows.select("bucket", F.col("id").alias(k), F.col("label").alias(f"{k}_label"))
        return near.meet(of("a"), of("b"), 2 * rows.count(), tag, (F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label")))

    out = [meet(m.where("NOT hot AND small"), "bucket-near")]
    large = m.where("NOT hot AND NOT small")
    if not large.isEmpty():
        pairs = materialize(_across(large).distinct(), "large-pairs")
        out.append(written([materialize(near.side(near.side(pairs, "a"), "b").where(near.test("a", "b")).select("a", "b"), "large-near")]))
        discard(pairs)
    if not hot.isEmpty():
        used = side()
        out += _by_rare(used, scheme, near, lambda rare: meet(rare.join(hot, "id").select("bucket", "id", "label"), "rare-near"))
        discard(used)
    discard(m, hot)
    return written([t for o in out for t in o.parts])


def near_duplicates(df: DataFrame, key: str, text: str, scheme: Scheme = Scheme()) -> DataFrame:
    """``id, first``: for every member of a group but its smallest id, that smallest id."""
    signed = materialize(signatures(df, key, text, scheme), "signatures")
    firsts = signed.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    copies = materialize(signed.select("id", "hash").join(firsts, "hash").where("id <> first").select("id", "first"), "copies")
    own = signed.join(copies, "id", "left_anti")
    members = bucket_members(own, scheme)
    near = sketch_near(signed, scheme)
    leads = members.where("id = lead").select("bucket", F.col("id").alias("a"))
    stars = near.stars(leads, members.where("id <> lead").select("bucket", F.col("id").alias("b")), members.count(), "star-near")
    links = materialize(verified(stars.distinct(), signed, signed, scheme), "star-links")
    discard(*stars.parts)
    labels = connected(links)
    rest = cross_pairs(members, labels, signed.select("id", "compared"), scheme, near)
    more = materialize(verified(rest.distinct(), signed, signed, scheme), "cross-links")
    discard(*rest.parts)
    discard(*members.parts, signed)
    if not more.isEmpty():
        discard(labels)
        labels = connected(links.union(more))
    discard(links, more)
    groups = labels.where("id <> label").select("id", F.col("label").alias("first"))
    # copies follow the text they repeat
    follow = copies.join(labels.select(F.col("id").alias("first"), "label"), "first", "left").select("id", F.coalesce("label", "first").alias("first"))
    return groups.unionByName(follow)

"""Per-document text quality statistics and natural prose.

Built-in functions give each document's statistics in one pass; mergeable KLL sketches of every statistic per language
follow by one small aggregation (partial sketches merge map-side), and merging the languages' sketches gives those of
the whole corpus. One row of quantiles per language is joined back for percentiles and robust z-scores, by which
distribution tails are flagged (NULL: no tail):

* ``n_words``       words: runs of letters or digits, each Han character by itself
* ``mean_word_len`` characters per run of letters or digits (Han characters count 1)
* ``symbol_ratio``  share of non-blank characters that are neither letter nor digit
* ``punct_lines``   share of non-blank lines that end in a sentence mark
* ``common_share``  share of words that are common words of the language (of any language where it has none listed)
* ``bare_share``    share of characters in pieces between sentence marks and line ends that hold no common word

The tails select the texts that can be no natural prose: a statistic far from its language's median, or, so that a
language of few documents has a measure too, a low common share or high bare share by the whole corpus. A z-score's
scale is the sketch's distance from the median to the nearer quartile (the other side may be full of junk), never below
a tenth of the median or ``least_scale``. Texts in a tail are then measured exactly, line by line: ``prose_share`` is
the share of their non-blank characters in sentences (headings between them are left out), and a text is no natural
prose where at least half of it lies outside sentences. Texts in no tail are natural prose.

Defined cases: NULL, empty and blank texts have NULL statistics and are no cases; NULL language is a language of its
own; a text without any letter has prose share 0; repeated rows are rated each; lines may be of any length. The tables
of common words are bounded (``MOST_WORDS``); a longer one is an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

STATS = ("n_words", "mean_word_len", "symbol_ratio", "punct_lines", "common_share", "bare_share")
MOST_WORDS = 5_000
MOST_LANGUAGES = 1_000

# Fixed value: the share of a text that lies in sentences, which prose exceeds.
LEAST_PROSE = 0.5

_HAN = "㐀-䶿一-鿿豈-﫿"
_LETTER = f"[\\p{{L}}\\p{{N}}&&[^{_HAN}]]"  # Java
_WORD = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
_HAN_CHAR = re.compile(f"[{_HAN}]")
# List marks, table signs and the marks that end a sentence.
_BULLET = re.compile(r"^\s*(?:[-*•·●○■□◆▪‣–—>+]\s+|[•·●○■□◆▪‣]|[（(]?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4}|[一二三四五六七八九十]{1,3})[）).、．](?!\d)|[①-⑳])\s*")
_RULER = re.compile(r"^[\s|+:=─━│┃┼╋═║\-_*]{3,}$")
_CELL = re.compile(r"^(?:n/?a|neg|pos|阴性|阳性|未检出|[-+±—/]|[<>≤≥]?\s*[-+]?\d[\d.,]*\s*%?)$", re.IGNORECASE)
_ENDS = re.compile(r"[。！？!?．]+[”’」』\"')）]*|(?<=[^\W\d_])\.+[”’\"')）]*(?![^\W_])|(?<=[^\W_%”\")）])\.+[”’\"')）]*(?=\s|$|[" + _HAN + r"])|(?<=[a-zA-Z])\.(?=\d)")
_LISTED = re.compile("[,，、;；|｜/]")
_SENTENCE_MARKS = "。！？!?.…．"


def _is_row(line: str) -> bool:
    """A table row: tabbed, barred, aligned or delimited cells, or fields with their names."""
    s = line.strip()
    if _RULER.match(s) or re.search(r"\S *\t+ *\S", s) or s.count("|") >= 2 or s.count("│") >= 1 or s.count("｜") >= 2:
        return True
    if len(re.findall(r"(?<=\S)=\S", s)) >= 2 or len(re.findall(r"\S {2,}(?=\S)", s)) >= 2:
        return True
    for sep in (",", ";", "，", "；", "|", "/", "  "):
        cells = [c.strip() for c in s.split(sep)]
        if len(cells) >= 2 and sum(bool(_CELL.match(c)) for c in cells[1:]) * 2 > len(cells) - 1 and not _CELL.match(cells[0]):
            return True
    return False


class ProseMeter:
    """Statistics of single texts, given the common words of all languages."""

    def __init__(self, common: list[str]):
        self.common = {w.lower() for w in common}
        self.han_common = sorted((w for w in self.common if _HAN_CHAR.search(w)), key=lambda w: (-len(w), w))
        self.han_pattern = re.compile("|".join(map(re.escape, self.han_common)) or r"(?!)")

    def _signs(self, sentence: str) -> tuple[int, int]:
        """(common words in ``sentence``, different ones of them)."""
        found = self.han_pattern.findall(sentence)
        found += [w for w in re.findall(r"[a-z]+", sentence.lower()) if w in self.common]
        return len(found), len(set(found))

    def _sentences(self, lines: list[str]) -> list[tuple[str, bool, bool]]:
        """(fragment, it ends as a sentence, it is a line by itself) of neighbouring text lines; wrapped lines are joined."""
        width = max(map(len, lines))
        out: list[tuple[str, bool, bool]] = []
        rest, whole = "", True
        for i, line in enumerate(lines):
            at = 0
            for m in _ENDS.finditer(line):
                out.append((rest + line[at : m.end()], True, False))
                rest, at, whole = "", m.end(), False
            rest += line[at:]
            if rest.strip():
                full = len(line) >= max(12, 0.7 * width)
                if i + 1 < len(lines) and full:
                    rest += " " if not _HAN_CHAR.search(line[-1:]) and line[-1:] != "-" else ""
                    continue
                out.append((rest, False, whole))
            rest, whole = "", True
        return out

    def prose_chars(self, text: str) -> tuple[int, int]:
        """(non-blank characters in sentences, non-blank characters that count)."""
        size = lambda s: len(s) - sum(map(str.isspace, s))
        good = total = 0
        run: list[str] = []
        parts: list[tuple[str, bool, bool] | None] = []

        def close() -> None:
            if run:
                parts.extend(self._sentences(run))
                run.clear()

        for line in text.splitlines():
            if not line.strip():
                close()
                continue
            m = _BULLET.match(line)
            if _is_row(line):
                close()
                total += size(line)
                parts.append(None)
            elif m and not (self._signs(line)[0] >= 2 and _ENDS.search(line, m.end())):
                close()
                total += size(line)
                parts.append(None)
            else:
                if m:
                    close()
                run.append(line)
        close()
        seen = Counter(p[0].strip() for p in parts if p)
        verdicts: list[tuple[int, bool | None]] = []
        for p in parts:
            if p is None:
                verdicts.append((0, False))
                continue
            s, ended, alone = p
            n = size(s)
            every, different = self._signs(s)
            letters = sum(map(str.isalpha, s))
            words = len(_WORD.findall(s))
            # one common word in some forty words at least: runs of random signs hit a few by chance
            natural = letters >= 0.5 * n and every * 40 >= words and seen[s.strip()] <= 3
            if ended:
                ok: bool | None = natural and every >= 1
            else:
                ok = natural and different >= (2 if _HAN_CHAR.search(s) else 4) and n >= 20 and len(_LISTED.findall(s)) < 5
                if not ok and alone and n <= 40:
                    ok = None  # a heading, if a sentence follows
            verdicts.append((n, ok))
        for k, (n, ok) in enumerate(verdicts):
            if ok is None:
                if k + 1 < len(verdicts) and verdicts[k + 1][1]:
                    continue
                ok = False
            total += n
            good += n if ok else 0
        return good, total

    def share(self, text: str) -> float:
        """Share of the non-blank characters that lie in sentences."""
        good, total = self.prose_chars(text)
        return good / total if total else 0.0


def common_words(common: DataFrame) -> dict[str | None, list[str]]:
    """The bounded table of common words by language."""
    rows = common.select(F.col("lang").cast("string"), F.col("word").cast("string")).where("word <> ''").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"at most {MOST_WORDS} common words")
    out: dict[str | None, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.word)
    return out


def _choice(words: list[str]) -> str:
    """Java pattern of any of ``words``, the longest first. Words of one beginning share a branch, and a look ahead at
    the first character keeps the branches from being tried where none fits."""
    quoted = lambda w: re.sub(r"[^\w\s]", r"\\\g<0>", w)
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(w[1:])
    single = [c for c, rest in by_first.items() if rest == [""]]
    branches = [quoted(c) + "(?:" + "|".join(map(quoted, rest)) + ")" for c, rest in by_first.items() if rest != [""]]
    if single:
        branches.append("[" + "".join(map(quoted, single)) + "]")
    return f"(?=[{''.join(map(quoted, by_first))}])(?:{'|'.join(branches)})"


class CommonWords:
    """Columns about the common words of a bounded list: those in Han characters stand unspaced, single characters are
    looked up rather than matched, and longer ones come before the characters they are made of."""

    def __init__(self, words: list[str]):
        han, other = [w for w in words if _HAN_CHAR.search(w)], [w.lower() for w in words if not _HAN_CHAR.search(w)]
        self.single = "".join(sorted({w for w in han if len(w) == 1}))
        self.longer = _choice(long) if (long := [w for w in han if len(w) > 1]) else None
        self.other = f"(?iu){_choice(other).replace('(?:', f'(?<!{_LETTER})(?:', 1)}(?!{_LETTER})" if other else None

    def count(self, text: Column) -> Column:
        """Han characters in common words, and other common words."""
        rest = F.regexp_replace(text, self.longer, "") if self.longer else text
        n = F.length(text) - F.length(F.translate(rest, self.single, ""))
        return n + F.regexp_count(text, F.lit(self.other)) if self.other else n

    def within(self, text: Column) -> Column:
        """Whether there is any."""
        out = F.length(F.translate(text, self.single, "")) < F.length(text)
        for pattern in (self.longer, self.other):
            out = out | text.rlike(pattern) if pattern else out
        return out


def text_stats(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang``, the statistics and the text of every document. ``common`` is the fixed table of common words."""
    by_lang = common_words(common)
    every = [w for words in by_lang.values() for w in words]
    src = docs.select(F.col(key).alias(key), F.col("lang").cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    t, w = F.col("text"), F.col("_w")
    without = lambda pattern: F.length(F.regexp_replace(w, pattern, ""))
    found = CommonWords(every).count(w)
    for lang, words in by_lang.items():
        if lang is not None:
            found = F.when(F.col("lang") == lang, CommonWords(words).count(w)).otherwise(found)
    common_in = CommonWords(every).within
    # counts first, so that each is made once however many ratios use it
    counts = src.withColumn("_w", F.when(t.rlike(r"\S"), t)).withColumns({
        "_packed": without(r"\s++").cast("double"),
        "_letters": (F.length(w) - without(r"[\p{L}\p{N}]++")).cast("double"),
        "n_words": (F.length(w) - without(f"[{_HAN}]++") + F.regexp_count(w, F.lit(f"{_LETTER}++"))).cast("double"),
        "_common": found.cast("double"),
        "_lines": F.regexp_extract_all(w, F.lit(r"[^\s][^\n\r]*+"), F.lit(0)),
        "_pieces": F.split(w, r"[。！？!?．\n\r]++|(?<=[a-z)])\. "),
    })
    ended = F.size(F.filter("_lines", lambda s: s.rlike("[。！？!?.…．][”’」』\"')） ]*$")))
    bare = F.aggregate(F.filter("_pieces", lambda s: ~common_in(s)), F.lit(0), lambda n, s: n + F.length(s))
    whole = F.aggregate("_pieces", F.lit(0), lambda n, s: n + F.length(s))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.when(w.isNotNull(), F.lit(0.0)))
    return counts.select(
        key,
        "lang",
        "n_words",
        share(F.col("_letters"), F.col("n_words")).alias("mean_word_len"),
        (1 - share(F.col("_letters"), F.col("_packed"))).alias("symbol_ratio"),
        share(ended.cast("double"), F.size("_lines")).alias("punct_lines"),
        share(F.col("_common"), F.col("n_words")).alias("common_share"),
        share(bare.cast("double"), whole).alias("bare_share"),
        "text",
    )


def _quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """Of every statistic's sketch the percentiles, the median and the distance to the nearer quartile."""
    q = lambda s, p: F.kll_sketch_get_quantile_double(s + "_sketch", F.lit(p))
    grid = F.array(*(F.lit(i / 100) for i in range(101)))
    return sketches.select(
        *keys,
        *(F.kll_sketch_get_quantile_double(s + "_sketch", grid).alias(s + "_grid") for s in STATS),
        *(q(s, 0.5).alias(s + "_median") for s in STATS),
        *(F.least(q(s, 0.75) - q(s, 0.5), q(s, 0.5) - q(s, 0.25)).alias(s + "_spread") for s in STATS),
    )


def language_sketches(stats: DataFrame, k: int = 400) -> DataFrame:
    """One row per language with a mergeable quantile sketch of every statistic."""
    return stats.where(F.col("n_words").isNotNull()).groupBy("lang").agg(*(F.kll_sketch_agg_double(s, F.lit(k)).alias(s + "_sketch") for s in STATS))


def tails(stats: DataFrame, sketches: DataFrame, tail: float = 3.0, least_scale: float = 0.02) -> DataFrame:
    """``stats`` with each statistic's percentile (``_pct``), robust z-score (``_z``) and tail (``_tail``) in its
    language, and whether the tails select the text (``in_tail``)."""
    # one row per language: broadcast where they are few, as texts must not be gathered by language
    few = sketches.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    langs = _quantiles(sketches, "lang").withColumnRenamed("lang", "of_lang")
    langs = F.broadcast(langs) if few else langs
    merged = sketches.agg(F.count("*").alias("n_langs"), *(F.kll_merge_agg_double(s + "_sketch").alias(s + "_sketch") for s in STATS))
    whole = _quantiles(merged.where("n_langs > 0"))
    whole = whole.select(*(F.col(c).alias("all_" + c) for c in whole.columns if not c.endswith("_grid")))
    joined = stats.join(langs, stats["lang"].eqNullSafe(langs["of_lang"]), "left").join(F.broadcast(whole), F.lit(True), "left")  # one row at most
    below = lambda s: F.size(F.filter(s + "_grid", lambda v: v <= F.col(s)))
    pct = [F.when(F.col(s).isNotNull(), F.greatest(below(s) - 1, F.lit(0)) / 100).alias(s + "_pct") for s in STATS]

    def z(s: str, of: str = "") -> Column:
        median = F.col(of + s + "_median")
        return (F.col(s) - median) / F.greatest(1.4826 * F.col(of + s + "_spread"), F.abs(median) / 10, F.lit(least_scale))

    flags = [F.when(z(s) <= -tail, "low").when(z(s) >= tail, "high") for s in STATS]
    far = (z("common_share", "all_") <= -tail) | (z("bare_share", "all_") >= tail)
    for f in flags:
        far = far | f.isNotNull()
    named = [f.alias(s + "_tail") for s, f in zip(STATS, flags, strict=True)]
    return joined.select(*stats.columns, *pct, *(z(s).alias(s + "_z") for s in STATS), *named, F.coalesce(far, F.lit(False)).alias("in_tail"))


def rate(stats: DataFrame, common: DataFrame, tail: float = 3.0) -> DataFrame:
    """Statistics with percentiles, z-scores and tails, the ``prose_share`` of texts in a tail, and ``is_prose``."""
    stats = materialize(stats, "text-stats")
    rated = tails(stats, materialize(language_sketches(stats), "language-sketches"), tail)
    words = [w for by in common_words(common).values() for w in by]
    kept = [c for c in rated.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = ProseMeter(words)
        for b in batches:
            shares = [meter.share(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(shares, pa.float64())], [*kept, "prose_share"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rated.schema if f.name != "text") + ", prose_share double"
    measured = rated.where("in_tail").mapInArrow(run, schema)
    others = rated.where("NOT in_tail").drop("text").withColumn("prose_share", F.lit(None).cast("double"))
    is_prose = F.when(F.col("n_words").isNotNull(), F.coalesce(F.col("prose_share") > LEAST_PROSE, F.lit(True)))
    return measured.unionByName(others).withColumn("is_prose", is_prose)

"""Visually identical text in one consistent form.

Characters handled (fixed classes): full-width letters and digits, split accents, invisible characters, spaces other
than the plain one, radical signs that stand for ordinary characters, and letters of another script inside a Latin
word. Everything else (Chinese punctuation, full-width marks, composed accents, Greek names and units) stays.

The operator ``canonicalize`` works on long (table_name, row_key, field_name, value) rows:

1. one pass keeps the values that hold any such character and lists their tokens with letters that are not plain Latin;
2. clean Latin words of all values are counted, joined by *skeleton* (what a word looks like) to these tokens only, and
   both are co-grouped in buckets of the skeleton's hash, where a trie of the bucket's words is traversed over the raw
   token by a weighted edit automaton: look-alikes and ignorable characters cost nothing, whatever their reading, and a
   letter that looks like a small capital costs 1 up to a budget; of the words reached the cheapest is selected, then
   the most frequent;
3. the values are rebuilt from those spellings; tokens without a match go through the table, as do all signs outside
   tokens. A value is changed if what is rebuilt differs from it.

A look-alike may be read in several ways (an upsilon as u, v or y), of which the table knows one: there the vocabulary
decides. Vocabulary and tokens are never gathered on the driver; a bucket holds the distinct words of some skeletons.
``canonical_text`` is the table form for one string, used wherever texts are compared.

Defined cases: NULL stays NULL and is never changed, empty texts stay empty; a tab or line break is white space of
the layout and no look-alike of a space; a token that no word spells and that has no Latin letter (a Greek name) stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import finished, materialize

# Cyrillic and Greek letters and the Latin letters they look like. Lower-case Greek letters that names
# and units use (alpha, beta, kappa, mu and the like) are none.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮаеѕіјорсухһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "οινρυ",
        "ABESIJKMHOPCTYXYaesijopcyxhdqw" + "ABEZHIKMNOPTYX" + "oivpu",
        strict=True,
    )
)
# The other readings of look-alike letters, and Cyrillic letters that look like small capitals.
READINGS = {"υ": "vy", "ν": "u", "ι": "l", "Ι": "l", "І": "l"}
SMALL_CAPITALS = {"в": "B", "к": "Kk", "м": "M", "н": "H", "т": "T"}
# Radical signs without a compatibility mapping and the ideographs they are equivalent to.
RADICALS = dict(
    zip(
        "⺁⺂⺃⺄⺅⺆⺇⺈⺉⺊⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺳⺴⺵⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
        "厂乛乚乙亻冂𠘨刀刂卜㔾小小兀尣尢𡯂巳幺彑彐忄㣺扌攵旡日月歺母民氵氺灬爫爫丬牛犭王疋目示礻竹糹纟罓罒㓁网罒羊羊羊耂肀聿肉臼艹艹艹虎衤覀西见角角讠贝足车辶辶辶邑钅長镸长门阜阝雨青韦页风飞食食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
        strict=True,
    )
)
RADICALS["⻳"] = "龟"


def _class(*ranges: tuple[int, int]) -> str:
    """Inside of a character class of code point ranges, good for Python and Java."""
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges)


# Code points of the handled classes.
INVISIBLE = _class((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0))
SPACES = _class((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
FULLWIDTH = _class((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))
RADICAL_SIGNS = _class((0x2E80, 0x2EF3), (0x2F00, 0x2FD5))
ACCENTS = _class((0x300, 0x36F))
_OTHER = "".join(LOOKALIKES)
_SMALL = "".join(SMALL_CAPITALS)
_LATIN = "A-Za-z" + _class((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F))

SUSPECT_CLASS = f"[{FULLWIDTH}{ACCENTS}{INVISIBLE}{SPACES}{RADICAL_SIGNS}{_OTHER}{_SMALL}]"
_SUSPECT = re.compile(SUSPECT_CLASS)
_PLAIN_WIDTH = {ord(c): ord(c) - 0xFEE0 for a, b in re.findall("(.)-(.)", FULLWIDTH) for c in map(chr, range(ord(a), ord(b) + 1))}


def _expand(cls: str) -> Iterator[int]:
    i = 0
    while i < len(cls):
        if i + 2 < len(cls) and cls[i + 1] == "-":
            yield from range(ord(cls[i]), ord(cls[i + 2]) + 1)
            i += 3
        else:
            yield ord(cls[i])
            i += 1


def _char_table() -> dict[int, int | str | None]:
    """Every handled character but look-alike letters and accents, built from the classes above."""
    table: dict[int, int | str | None] = dict(_PLAIN_WIDTH)
    table.update(dict.fromkeys(_expand(INVISIBLE)))
    table.update(dict.fromkeys(_expand(SPACES), " "))
    for c in _expand(RADICAL_SIGNS):
        plain = RADICALS.get(chr(c)) or unicodedata.normalize("NFKC", chr(c))
        if plain != chr(c):
            table[c] = plain
    return table


_CHARS = _char_table()
_LOOK = {ord(a): b for a, b in LOOKALIKES.items()}
_TOKEN = re.compile(f"[{_LATIN}{ACCENTS}{_OTHER}]*[{_OTHER}][{_LATIN}{ACCENTS}{_OTHER}]*")
#: Runs of characters that a Latin word may be written with, and the characters among them that no clean word has.
_RAW_TOKEN = re.compile(f"[{_LATIN}{FULLWIDTH}{ACCENTS}{INVISIBLE}{_OTHER}{_SMALL}]{{2,}}")
_RAW_SIGN = re.compile(f"[{FULLWIDTH}{ACCENTS}{INVISIBLE}{_OTHER}{_SMALL}]")
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_OTHER_LETTER = re.compile("[\u0370-\u03FF\u0400-\u052F]")
_HAS_ACCENT = re.compile(f"[{ACCENTS}]")
_NOT_ALNUM = re.compile(r"[\W_]+")


def _is_word(token: str, text: str, start: int, end: int) -> bool:
    """A token to be spelled in Latin: it has a Latin letter, or at least two letters that all look Latin and is no
    part of a longer word of the other script."""
    letters = [c for c in token if not _HAS_ACCENT.match(c)]
    if _HAS_LATIN.search(token):
        return True
    apart = not _OTHER_LETTER.match(text[max(0, start - 1) : start]) and not _OTHER_LETTER.match(text[end : end + 1])
    return apart and len(letters) >= 2 and all(c in LOOKALIKES for c in letters)


def _spell(m: re.Match) -> str:
    token = m.group()
    return token.translate(_LOOK) if _is_word(token, m.string, m.start(), m.end()) else token


def canonical_text(text: str | None) -> str | None:
    """``text`` in the consistent form, by table."""
    if text is None or text.isascii() or not _SUSPECT.search(text):
        return text
    text = _TOKEN.sub(_spell, text.translate(_CHARS))
    return unicodedata.normalize("NFC", text) if _HAS_ACCENT.search(text) else text


def letters_and_digits(text: str | None) -> str:
    """Consistent form, lower case, letters and digits only; NULL as empty."""
    return _NOT_ALNUM.sub("", canonical_text(text).lower()) if text else ""


def raw_tokens(text: str) -> list[str]:
    """Different tokens of ``text``, as they stand, that are written with other than plain Latin letters and are to be
    spelled in Latin."""
    out = set()
    for m in _RAW_TOKEN.finditer(text):
        if _RAW_SIGN.search(m.group()) and _is_word(m.group().translate(_CHARS), text, m.start(), m.end()):
            out.add(m.group())
    return sorted(out)


#: Letters that are one and the same in a skeleton, since a look-alike may stand for either.
_FOLDED = ("uyl", "vvi")
_SKELETON = str.maketrans(*_FOLDED)
_LOOK_ALL = _LOOK | {ord(c): forms[0] for c, forms in SMALL_CAPITALS.items()}


def skeleton(token: str) -> str:
    """What a token looks like: look-alikes as Latin letters, accents composed, lower case, readings folded."""
    return unicodedata.normalize("NFC", token.translate(_CHARS).translate(_LOOK_ALL)).lower().translate(_SKELETON)


class VocabularyTrie:
    """Trie of words with counts, traversed over raw tokens by a weighted edit automaton.

    A look-alike letter in any of its readings, a full-width letter, a split accent and an ignorable character match at
    no cost; a letter that looks like a small capital costs ``SMALL_COST``. Of all words within the budget that spell a
    token the cheapest wins, then the more frequent, then the first in order.
    """

    SMALL_COST = 1
    BUDGET = 2

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for word, n in words.items():
            node = self.root
            for ch in unicodedata.normalize("NFD", word):
                node = node.setdefault(ch, {})
            node[""] = (word, n)

    def _edges(self, ch: str) -> list[tuple[str, int]]:
        """The letters that ``ch`` can stand for and what each costs."""
        plain = ch.translate(_CHARS)
        forms = [(plain, 0)] + [(c, 0) for c in LOOKALIKES.get(plain, "") + READINGS.get(plain, "")]
        return forms + [(c, self.SMALL_COST) for c in SMALL_CAPITALS.get(plain, "")]

    def spell(self, token: str, most: int = BUDGET) -> str | None:
        states = [(self.root, 0)]
        for ch in unicodedata.normalize("NFD", token):
            if ch.translate(_CHARS) == "":
                continue  # ignorable
            edges = self._edges(ch)
            states = [(node[form], cost + price) for node, cost in states for form, price in edges if form in node and cost + price <= most]
            if not states:
                return None
        ends = [(cost, -node[""][1], node[""][0]) for node, cost in states if "" in node]
        return min(ends)[2] if ends else None


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, tokens = [], []
        for i, v in enumerate(b.column("value").to_pylist()):
            if v is not None and ((found := raw_tokens(v)) or canonical_text(v) != v):
                keep.append(i)
                tokens.append(found)
        out = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("table_name", "row_key", "field_name", "value")), pa.array(tokens, pa.list_(pa.string()))], ["table_name", "row_key", "field_name", "value", "tokens"])


def _spellings(key, tokens: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    trie = VocabularyTrie(dict(zip(words["word"], words["n"], strict=True)))
    found = [(t, w) for t in tokens["token"] if (w := trie.spell(t)) is not None]
    return pd.DataFrame(found, columns=["token", "spelling"])


def respelled(text: str, known: dict[str, str]) -> str:
    """``text`` with the selected spellings of its raw tokens, all else by table."""
    if known:
        text = _RAW_TOKEN.sub(lambda m: known.get(m.group(), m.group()), text)
    return canonical_text(text)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [respelled(v, {p["token"]: p["spelling"] for p in pairs or []}) for v, pairs in zip(b.column("value").to_pylist(), b.column("spellings").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("table_name", "row_key", "field_name", "value")), pa.array(out, pa.string())], ["table_name", "row_key", "field_name", "value", "canonical"])


def canonicalize(values: DataFrame, buckets: int | None = None) -> DataFrame:
    """``table_name, row_key, field_name, value, canonical`` of the values that the consistent form changes."""
    spark = values.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = "table_name string, row_key string, field_name string, value string"
    values = values.select("table_name", "row_key", "field_name", "value")
    dirty = values.where(F.col("value").rlike(SUSPECT_CLASS)).mapInArrow(_suspects, base + ", tokens array<string>")
    # the few values to change are read by several steps
    dirty = materialize(dirty, "dirty-values")
    skel = F.udf(skeleton, "string", useArrow=True)
    tokens = dirty.select(F.explode("tokens").alias("token")).distinct().withColumn("skeleton", skel("token"))
    # the counted vocabulary: Latin words of all values that are clean as they stand
    words = F.regexp_extract_all("value", F.lit(f"(?<![{_LATIN}{ACCENTS}{_OTHER}])[{_LATIN}]{{2,}}(?![{_LATIN}{ACCENTS}{_OTHER}])"), F.lit(0))
    vocab = values.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # same folding as skeleton() for words of composed Latin letters
    vocab = vocab.withColumn("skeleton", F.translate(F.lower("word"), *_FOLDED))
    vocab = vocab.join(tokens.select("skeleton").distinct(), "skeleton", "left_semi")
    bucket = F.pmod(F.xxhash64("skeleton"), F.lit(n)).alias("bucket")
    spelled = tokens.select(bucket, "token").groupBy("bucket").cogroup(vocab.select(bucket, "word", "n").groupBy("bucket")).applyInPandas(_spellings, "token string, spelling string")
    # the spellings a value needs are gathered per value: no more than its own distinct tokens
    per_value = dirty.where(F.size("tokens") > 0).select("table_name", "row_key", "field_name", F.explode("tokens").alias("token"))
    per_value = per_value.join(spelled, "token").groupBy("table_name", "row_key", "field_name").agg(F.collect_list(F.struct("token", "spelling")).alias("spellings"))
    none = F.lit(None).cast("array<struct<token:string,spelling:string>>")
    plain = dirty.where(F.size("tokens") == 0).select("table_name", "row_key", "field_name", "value", none.alias("spellings"))
    mixed = dirty.where(F.size("tokens") > 0).drop("tokens").join(per_value, ["table_name", "row_key", "field_name"], "left")
    out = plain.unionByName(mixed.select("table_name", "row_key", "field_name", "value", "spellings")).mapInArrow(_rebuild, base + ", canonical string")
    return finished(out.where("canonical <> value"), "canonical-values", dirty)

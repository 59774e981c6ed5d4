r"""Several values packed in one field: infer the delimiters of each source, then split with positions kept.

A field's *source* is the column it comes from (``table.field``) unless the caller names a source column. Candidate
delimiters are scored over all rows of a source, of the values that the mark splits (marks inside quotes, inside
brackets or between two digits never count):

* **piece-count consistency** - the share of values whose number of pieces lies in the source's most frequent octave
  (2-3, 4-7, 8-15, ...), which one very long list doesn't disturb;
* **type regularity** - the share of values whose pieces are of one kind (id, number, name with or without Han
  characters) or alike in length.

The score is the product of both, each smoothed by ``weight`` values of ``prior``, so that it needs no least number of
rows. A candidate whose score stays below ``min_score`` is taken as an ordinary character of that source, all others
separate (values mix delimiters, so the winners are used together). One aggregation over a dozen numbers per source
gives the scores; the decision goes back as a join with one row per source, so nothing is collected.

Lists of ids are *dressed*: JSON, escaped JSON, braces or quotes stand around the values and hide no delimiter. There
the dressing is taken off first, and blanks are one more candidate.

Defined cases: NULL, empty or blank fields give no row; empty pieces are skipped and not counted in ``pos``;
repeated pieces are kept; an unclosed quote or bracket protects nothing. Extra columns of the input are ignored;
key and value columns are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The candidate delimiters, plain and full-width.
DELIMITERS = {
    "comma": ",，",
    "semicolon": ";；",
    "enumeration": "、､",
    "bar": "|｜¦",
    "slash": "/／",
}
# What stands around the values of a dressed list.
DRESSING = "[]{}()\"'\\“”‘’［］｛｝"
BLANK = "blank"
# Marks that enclose.
QUOTES = [('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"), ("「", "」"), ("『", "』"), ("＂", "＂"), ("＇", "＇")]
BRACKETS = [("(", ")"), ("（", "）"), ("[", "]"), ("［", "］"), ("【", "】"), ("〔", "〕"), ("《", "》"), ("{", "}"), ("｛", "｝"), ("<", ">"), ("〈", "〉")]

_CLASS_ESCAPED = set("[]\\^-&(){}|")


def _chars(text: str) -> str:
    return "".join("\\" + c if c in _CLASS_ESCAPED else c for c in text)


def _enclosed() -> str:
    parts = [f"\\Q{a}\\E[^{_chars(b)}]*\\Q{b}\\E" for a, b in BRACKETS]
    # a straight single quote between letters is an apostrophe
    parts += [(f"(?<![\\p{{IsLatin}}]){a}[^{_chars(b)}]*{b}" if a == "'" else f"\\Q{a}\\E[^{_chars(b)}]*\\Q{b}\\E") for a, b in QUOTES]
    return "|".join(parts)


def piece_pattern(marks: str) -> str:
    """Java pattern of one piece between the given delimiter characters."""
    cls = _chars(marks)
    return f"(?:{_enclosed()}|(?<=\\p{{Nd}})[{cls}](?=\\p{{Nd}})|[^{cls}])++"


def strip_piece(piece: Column) -> Column:
    """Drop spaces around a piece, then one pair of quotes that encloses all of it, then spaces again."""
    ws = "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$"
    bare = F.regexp_replace(piece, ws, "")
    for a, b in QUOTES:
        bare = F.regexp_replace(bare, f"^\\Q{a}\\E([^{_chars(a + b)}]*)\\Q{b}\\E$", "$1")
    return F.regexp_replace(bare, ws, "")


def pieces(value: Column, marks: str) -> Column:
    """Array of the non-empty stripped pieces of ``value`` (empty array for NULL)."""
    raw = F.regexp_extract_all(value, F.lit(piece_pattern(marks)), F.lit(0))
    return F.coalesce(F.filter(F.transform(raw, strip_piece), lambda p: p != ""), F.array().cast("array<string>"))


def _kind(piece: Column) -> Column:
    """Shape of a piece without its letters: which scripts and signs it has."""
    return F.concat(
        F.when(piece.rlike("\\p{IsHan}"), "h").otherwise(""),
        F.when(piece.rlike("^[\\p{Nd}.,%]+$"), "n").otherwise(""),
        F.when(piece.rlike("_"), "i").otherwise(""),
    )


def _candidates(v: Column, dressed: bool) -> list[tuple[str, Column, Column]]:
    """(name, whether the value holds it, pieces by it alone) of every candidate delimiter."""
    out = [(name, v.rlike("[" + _chars(marks) + "]"), pieces(v, marks)) for name, marks in DELIMITERS.items()]
    if dressed:
        cls = _chars("".join(DELIMITERS.values()))
        between = v.rlike(f"[^\\s{cls}]\\s+[^\\s{cls}]")
        out.append((BLANK, between, F.filter(F.split(v, "\\s+"), lambda p: p != "")))
    return out


def _bare(value: Column, dressed: bool) -> Column:
    return F.trim(F.translate(value, DRESSING, "")) if dressed else value


#: Octaves of piece counts; the last one is open.
OCTAVES = 8


def delimiter_scores(df: DataFrame, source: str, value: str, dressed: bool = False, weight: int = 8, prior: float = 0.8) -> DataFrame:
    """One row per source and candidate: ``source, delimiter, n_values, n_split, consistency, regularity, score``."""
    marks = "[" + _chars("".join(DELIMITERS.values())) + ("\\s" if dressed else "") + "]"
    held = df.select(F.col(source).alias("source"), _bare(F.col(value), dressed).alias("v")).where(F.col("v").rlike(marks))
    cols = [F.struct(F.lit(name).alias("delimiter"), has.alias("held"), p.alias("p")) for name, has, p in _candidates(F.col("v"), dressed)]
    long = held.select("source", F.explode(F.array(*cols)).alias("c")).select("source", "c.*").where("held")
    # a mark that stands only in protected places gives one piece equal to the whole value and is no evidence
    n = F.size("p")
    kinds = F.size(F.array_distinct(F.transform("p", _kind)))
    lens = F.transform("p", lambda p: F.length(p))
    regular = (kinds == 1) | (F.array_max(lens) <= 3 * F.array_min(lens))
    octave = F.least(F.floor(F.log2(n)), F.lit(OCTAVES))
    agg = long.groupBy("source", "delimiter").agg(
        F.count("*").alias("n_values"),
        F.count_if(n >= 2).alias("n_split"),
        F.count_if((n >= 2) & regular).alias("n_regular"),
        F.greatest(*(F.count_if((n >= 2) & (octave == k)) for k in range(1, OCTAVES + 1))).alias("n_consistent"),
    )
    smooth = lambda c: (F.col(c) + weight * prior) / (F.col("n_split") + weight)
    out = agg.select("source", "delimiter", "n_values", "n_split", smooth("n_consistent").alias("consistency"), smooth("n_regular").alias("regularity"))
    return out.withColumn("score", F.col("consistency") * F.col("regularity"))


def split_values(df: DataFrame, key: str, source: str, value: str, min_score: float = 0.5, dressed: bool = False) -> DataFrame:
    """``source, row_key, pos, val``: one row per value of the fields that hold two or more."""
    all_marks = "".join(DELIMITERS.values())
    anywhere = "[" + _chars(all_marks) + ("\\s" if dressed else "") + "]"
    marked = df.select(F.col(source).alias("source"), F.col(key).cast("string").alias("row_key"), _bare(F.col(value), dressed).alias("v")).where(F.col("v").rlike(anywhere))
    # the marks that do not separate in a source: at most the dozen candidates for each of the caller's sources
    ordinary = delimiter_scores(df, source, value, dressed).where(F.col("score") < min_score)
    plain = ordinary.groupBy("source").agg(F.array_sort(F.collect_set("delimiter")).alias("plain"))
    joined = marked.join(plain, "source", "left")
    is_plain = lambda name: F.array_contains(F.coalesce("plain", F.array().cast("array<string>")), name)
    v = F.col("v")
    for i, (name, marks) in enumerate(DELIMITERS.items()):
        # hide the ordinary marks of this source behind private-use characters while splitting
        hidden = "".join(chr(0xE000 + 16 * i + k) for k in range(len(marks)))
        v = F.when(is_plain(name), F.translate(v, marks, hidden)).otherwise(v)
    parts = pieces(v, all_marks)
    if dressed:
        at_blanks = F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, "\\s+"))), lambda p: p != "")
        parts = F.when(is_plain(BLANK), parts).otherwise(at_blanks)
    shown_from = "".join(chr(0xE000 + 16 * i + k) for i, m in enumerate(DELIMITERS.values()) for k in range(len(m)))
    out = joined.select("source", "row_key", parts.alias("p")).where(F.size("p") >= 2)
    out = out.select("source", "row_key", F.posexplode("p").alias("i", "val"))
    return out.select("source", "row_key", (F.col("i") + 1).cast("int").alias("pos"), F.translate("val", shown_from, all_marks).alias("val"))


def split_ids(df: DataFrame, key: str, value: str) -> DataFrame:
    """``row_key, pos, val`` of one column of ids in whatever list form (JSON, escaped JSON, braces, delimiters, blanks)."""
    one = df.select(F.lit("ids").alias("source"), F.col(key).alias("row_key"), F.col(value).alias("value"))
    return split_values(one, "row_key", "source", "value", dressed=True).drop("source")

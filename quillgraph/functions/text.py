"""Text functions: Column in, Column out, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space.
WHITE_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SENTENCE_ENDS = "。！？!?；;"
CLAUSE_MARKS = "，。；：、！？!?；;,."
# Characters ignored when evidence is looked up in a text.
IGNORED_IN_EVIDENCE = " \t\r\n，。、；：？！,.;:?!\"'“”‘’（）()《》<>—…·【】"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def stripped(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space runs as one plain space, none at the ends; NULL as ''."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def nfkc(c: Column) -> Column:
    """Compatibility composition, which has no built-in."""

    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.pandas_udf(compose, "string")(c)


def blank_markup(c: Column) -> Column:
    """Entities first, then tags, as spaces; control characters out; white space squeezed."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "&[a-zA-Z#0-9]+;", " ")
    c = F.regexp_replace(c, "<[^>]*>", " ")
    return squeeze(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""))


def clean_text(c: Column) -> Column:
    return blank_markup(nfkc(F.coalesce(c, F.lit(""))))


def sentences(c: Column) -> Column:
    """Pieces that end after a sentence mark, which is kept; blank pieces are dropped."""
    return F.filter(F.transform(F.split(c, f"(?<=[{SENTENCE_ENDS}])"), strip), lambda s: s != "")


def plain_sentences(c: Column) -> Column:
    """Pieces between sentence marks or line breaks, marks dropped."""
    return F.filter(F.transform(F.split(c, "[。！？；;\\n]+"), squeeze), lambda s: s != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fff]+|[a-zA-Z0-9]+(?:[-.][a-zA-Z0-9]+)*+|[^\\s\\u4e00-\\u9fffa-zA-Z0-9]"), F.lit(0))


def clauses(c: Column) -> Column:
    """Clauses as structs (start, text): text stripped, offsets of the unstripped pieces."""
    parts = F.split(c, f"[{CLAUSE_MARKS}]")
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p) + 1).cast("int").alias("at"),
        F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), strip(p).alias("text")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    return F.filter(F.aggregate(parts, zero, step)["out"], lambda x: x["text"] != "")


def cjk_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit("[\\u4e00-\\u9fff]")) / F.length(c)).otherwise(F.lit(0.0))


def bigrams(c: Column) -> Column:
    """Different pairs of neighbouring characters; one character is its own, '' has none."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def supported(evidence: Column, content: Column) -> Column:
    """The evidence, without marks and spaces, stands in the content, or half of its bigrams do."""
    drop = lambda c: F.translate(F.coalesce(c, F.lit("")), IGNORED_IN_EVIDENCE, "")
    ev, ct = drop(evidence), drop(content)
    own = bigrams(ev)
    hits = F.size(F.filter(own, lambda g: F.contains(ct, g)))
    return F.when(ev == "", F.lit(False)).otherwise(F.contains(ct, ev) | (hits * 2 >= F.size(own)))


def trim_boundary(c: Column) -> Column:
    # Marks and function characters stripped from both ends of a term.
    return F.btrim(c, F.lit("，。；：、！？!?\"'“”‘’（）()《》〈〉【】[]{}…—,.;: 的地得之了着过在与和及或等这那该其为已被而"))


# Filler at the end of a term, the first that fits is taken off once.
FILLER_TAILS = ("甚至", "以及", "并且", "或者", "等等", "等的", "等", "加之", "此外", "隨後", "继而", "還有", "还有")


def strip_filler(c: Column) -> Column:
    return reduce(lambda rest, f: F.when(F.endswith(c, F.lit(f)), strip(F.substring(c, F.lit(1), F.length(c) - len(f)))).otherwise(rest), reversed(FILLER_TAILS), c)


# Function characters that no template term holds.
TEMPLATE_NOISE = "的地得之了着过出并于等或和及与则也都而其为被把将从对在是有这那尚再既且但虽还另须"


def template_term(c: Column) -> Column:
    t = strip(c)
    return F.when((t == "") | t.rlike(f"[{TEMPLATE_NOISE}]"), F.lit(None)).otherwise(t)


# Endings of disease names.
DISEASE_ENDS = ("病", "症", "炎", "癌", "瘤", "肿", "痛", "毒", "热", "风", "伤", "障碍", "功能不全", "综合症", "综合征", "感染", "出血", "中毒", "硬化", "衰竭", "梗死", "栓塞", "痉挛", "麻痹", "昏迷", "水肿", "坏死", "增生", "结核", "紊乱", "功能紊乱", "缺陷", "畸形", "溃疡")


def is_disease_title(c: Column) -> Column:
    t = strip(c)
    return F.coalesce(F.length(t).between(2, 20) & t.rlike("(" + "|".join(DISEASE_ENDS) + ")$"), F.lit(False))


def is_latin_word(c: Column) -> Column:
    """No CJK character and at least one letter."""
    return F.coalesce(~c.rlike("[\\u4e00-\\u9fff]") & c.rlike("\\p{L}"), F.lit(False))


# Closed classes of terms and the endings of their names.
TYPE_ENDS = {
    "Drug": ("药", "素", "剂", "林", "霉素", "肽", "醇", "酚", "酸", "酮", "胺", "苷", "单抗", "疫苗", "注射液", "片剂", "胶囊", "糖皮质激素"),
    "Treatment": ("治疗", "疗法", "手术", "康复", "接种", "化疗", "放疗", "吸氧", "移植", "注射", "护理", "隔离", "隔離", "透析", "理疗", "牵引"),
    "Examination": ("检查", "测定法", "检测", "筛查", "试验", "扫描", "镜检", "超声", "造影", "活检", "监测", "测定", "拍片", "阅片"),
}


def plausible(term: Column, kind: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """A term of a closed class is in its lexicon or ends like one; other classes pass."""
    out = F.lit(True)
    for name, ends in TYPE_ENDS.items():
        ok = term.rlike("(" + "|".join(ends) + ")$")
        if lexicon and lexicon.get(name):
            ok = ok | term.isin(*lexicon[name])
        out = F.when(kind == name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def redact(c: Column) -> Column:
    """Error text without secrets, at most 1,000 characters."""
    return F.when(F.lower(c).rlike("password=|token=|cookie=|api_key="), F.lit("[redacted]")).otherwise(F.left(c, F.lit(1000)))

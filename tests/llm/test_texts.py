"""Canonical text, truncation, quality and encoding on small fixtures."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import bpe, canonical, quality, truncation

VALUES = "table_name string, row_key string, field_name string, value string, extra int, tokens string"


def values(spark, texts):
    return spark.createDataFrame([("t", str(i), "f", v, 1, "x") for i, v in enumerate(texts)], VALUES)


CASES = [
    ("ТΝF-α", "TNF-α"), ("67μg", "67μg"), ("β受体", "β受体"), ("ＥＭＶ３型", "EMV3型"), ("a​b\xadc", "abc"), ("甲 乙 丙　丁", "甲 乙 丙 丁"),
    ("⾻膜⽬系", "骨膜目系"), ("Tunе́nvi", "Tunénvi"), ("ü", "ü"), ("，。（）－：", "，。（）－："), ("Dasarrü É", "Dasarrü É"), ("x\ty\n", "x\ty\n"), ("", ""), ("α", "α"), ("КНТ", "KHT"),
]


def test_canonical_text():
    for dirty, clean in CASES:
        assert canonical.canonical_text(dirty) == clean
        assert canonical.canonical_text(clean) == clean
    assert canonical.canonical_text(None) is None
    assert canonical.letters_and_digits("Ａ-b，Ｃ 3。") == "abc3" and canonical.letters_and_digits(None) == ""


def test_operator_finds_what_the_table_changes(spark):
    texts = [d for d, _ in CASES] + [None, "甲" * 100_000 + "​", "KHT", "TNF-α TNF", "Tunénvi"] + ["same​"] * 3
    got = {r.row_key: r.canonical for r in canonical.canonicalize(values(spark, texts)).collect()}
    assert got == {str(i): canonical.canonical_text(v) for i, v in enumerate(texts) if canonical.canonical_text(v) != v}
    assert canonical.canonicalize(values(spark, [])).count() == 0


def test_trie_prefers_cheap_then_frequent():
    trie = canonical.VocabularyTrie({"KHT": 5, "Kht": 9, "TNF": 1, "Luvo": 3, "Lvvo": 8, "Sédil": 2, "MKB": 4, "MkB": 2})
    assert trie.spell("КНТ") == "KHT" and trie.spell("T\u200bΝF") == "TNF" and trie.spell("TNX") is None
    assert trie.spell("ＫHТ") == "KHT" and trie.spell("Kht") == "Kht" and trie.spell("kht") is None
    assert trie.spell("Lυvo") == "Lvvo" and trie.spell("Lνvo") == "Lvvo" and trie.spell("Luvо") == "Luvo"
    assert trie.spell("Sе\u0301dil") == "Sédil" and trie.spell("Sedil") is None
    assert trie.spell("Mкв") == "MKB" and trie.spell("Mкв", most=1) is None and trie.spell("MкВ", most=1) == "MKB"


def test_vocabulary_decides_where_the_table_knows_one_reading(spark):
    """An upsilon is u by the table; here only the words with v and y are known, of two the more frequent wins."""
    texts = ["Rivelo 片", "Ryvelo", "Ryvelo", "Rivelo", "Riυelo 胶囊", "Rυvelo", "Xaυemu", "NF-κB", "PKМ", "MKB MKB", "Mкв", "КВМ", "Rivelo\u3000"]
    got = {r.row_key: r.canonical for r in canonical.canonicalize(values(spark, texts)).collect()}
    assert got == {"4": "Rivelo 胶囊", "5": "Ryvelo", "6": "Xauemu", "8": "PKM", "10": "MKB", "11": "KBM", "12": "Rivelo "}
    assert canonical.canonical_text("Riυelo 胶囊") == "Riuelo 胶囊" and canonical.canonical_text("Mкв") == "Mкв"


def test_words_of_other_scripts_stay():
    for t in ("Сад и она", "Сталин", "οικος λόγος", "νερό"):
        assert canonical.canonical_text(t) == t and not canonical.raw_tokens(t)
    assert canonical.canonical_text("⺮⻑⻆⻌⻣") == "竹長角辶骨"


def docs(spark, contents, source="s"):
    return spark.createDataFrame([(i, source if i % 5 else None, c, True, "x") for i, c in enumerate(contents)], "doc_id long, source string, content string, closed boolean, t string")


def corpus(n=400):
    rnd = random.Random(2)
    who, what, how = ["病人甲", "病人乙", "老年居民", "孕产妇"], ["出现头痛", "接受显影检查", "服用片剂", "再次就诊"], ["逐渐加重", "没有变化", "完全消失"]
    return ["".join(f"{rnd.choice(who)}{rnd.randint(1, 90)}日后{rnd.choice(what)}，{rnd.choice(how)}。" for _ in range(rnd.randint(3, 8))) for _ in range(n)]


def test_truncation(spark):
    whole = corpus()
    cut = [w[: len(w) - k] for k, w in zip([1, 2, 3, 5, 7] * 8, whole, strict=False)]
    marked = [c + m for c, m in zip([c for c in cut if not c.endswith("。")], ["……", "...", "�", " [全文]", "&#12"], strict=False)]
    closed = [w + x for w, x in zip(whole, ["关键词：头痛；检查；片剂", "（资料整理：第3小组）", "(Notes kept here)"], strict=False)]
    rest = ["", "   ", None, "（内容待补）", "No abstract available.", "暂无简介。"]
    texts = whole + cut + marked + closed + rest
    found = {r.doc_id for r in truncation.truncated(docs(spark, texts)).where("is_cut").collect()}
    want = {i for i in range(len(whole), len(whole) + len(cut)) if not texts[i].endswith("。")} | set(range(len(whole) + len(cut), len(whole) + len(cut) + len(marked)))
    assert found == want
    report = {r.source: (r.n_texts, r.n_truncated) for r in truncation.truncation_report(docs(spark, texts)).collect()}
    assert sum(n for _, n in report.values()) == len(want) and sum(n for n, _ in report.values()) == len(texts) - len(rest)
    assert truncation.truncated(docs(spark, [])).count() == 0


def test_trigrams_decide(spark):
    """The last trigram acquits a text without a closing mark and convicts one with it."""
    whole = [f"{c}参见第{i % 7}号。附件另存。{d}" for i, (c, d) in enumerate(zip(corpus(300), corpus(300), strict=True))]
    signed = [c[:-1] + "。记录到此为止" for c in corpus(150)]
    opened = [c + "参见第3号。" for c in corpus(5)]
    unsigned = [c[:-2] for c in corpus(5)]
    found = {r.doc_id for r in truncation.truncated(docs(spark, whole + signed + opened + unsigned)).where("is_cut").collect()}
    assert found == set(range(450, 460))


def test_copies_of_a_cut_text_and_torn_words(spark):
    """A third of all rows is one cut text; fragments of a word torn in several texts are no words of their own."""
    whole = [c + f" The residents of ward {i} reported the changes." for i, c in enumerate(corpus(400))]
    copies = [corpus(1)[0] + "第3日后再次就"] * 200
    torn = [c + " The residents of ward 4 repor" for c in corpus(12)]
    rows = whole + copies + torn
    df = docs(spark, rows)
    found = [r.doc_id for r in truncation.truncated(df).where("is_cut").collect()]
    assert sorted(found) == list(range(400, len(rows)))
    none = df.withColumn("doc_id", F.expr("if(doc_id % 2 = 0, doc_id, null)"))
    assert truncation.truncated(none).where("is_cut").count() == len(found)


PROSE = "在医院登记的病例里，约有三成出现头痛，但是不需要手术。\n目前的检查没有显示其他问题，可以再观察七天。"
JUNK = ["首页\n菜单\n帮助\n" * 20, "- 甲\n- 乙\n- 丙\n- 丁", "a\t1\t2\nb\t3\t4", "| a | 1 |\n|---|---|\n| b | 2 |", "。" * 80, "xqzkvbnm trwplk " * 20, PROSE.encode().decode("latin-1"), "甲病，乙症，丙炎，丁瘤，戊癌，己痛，庚热", "c0=a; c1=1\nc0=b; c1=2", "测试文本 " * 40]
GOOD = [PROSE, "概述\n" + PROSE, "问：" + PROSE.replace("\n", "\n答："), PROSE + "\n- 甲病\n- 乙症", "他在医院里。", "The patient was seen in the ward and did not need the drug.", "第一次检查的结果没有变化，可以在一周以后\n再次到医院做检查，目前不需要其他的治疗，\n但是应注意休息。"]


def test_prose(spark):
    words = spark.createDataFrame([("zh", w) for w in "的 在 有 但 是 约 可以 目前 其他 没有 里 后 再 不 需要 应 注意".split()] + [("en", w) for w in "the was in and not did".split()], "lang string, word string")
    rows = [(i, "zh" if i % 3 else None, t, 1) for i, t in enumerate(GOOD * 3 + JUNK + [None, "", " \n "])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, n_words int")
    rated = {r.doc_id: r for r in quality.rate(quality.text_stats(df, words), words).collect()}
    assert len(rated) == len(rows)
    for i, _, t, _ in rows:
        r = rated[i]
        if not t or not t.strip():
            assert r.is_prose is None and r.n_words is None
        else:
            assert r.is_prose == (t in GOOD), (t, r)
            assert 0 <= r.symbol_ratio_pct <= 1
    assert quality.rate(quality.text_stats(df.limit(0), words), words).count() == 0


def stat_rows(spark, n, **odd):
    """``n`` alike documents of one language and one odd document."""
    base = {"n_words": 90.0, "mean_word_len": 1.0, "symbol_ratio": 0.1, "punct_lines": 1.0, "common_share": 0.3, "bare_share": 0.0}
    rows = [(i, "zh", *(v * (1 + i % 5 / 100) for v in base.values()), JUNK[3]) for i in range(n)] + [(n, "zh", *(base | odd).values(), JUNK[3])]
    return spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{s} double" for s in quality.STATS) + ", text string")


def test_sketches_select_what_is_measured(spark):
    """A text is measured where the sketches of its language flag a tail; other sketches select other rows."""
    words = spark.createDataFrame([("zh", "的")], "lang string, word string")
    odd = stat_rows(spark, 100, symbol_ratio=0.5)
    r = {x.doc_id: x for x in quality.rate(odd, words).collect()}
    assert [i for i, x in r.items() if x.is_prose is False] == [100] and r[100].prose_share == 0
    assert (r[100].symbol_ratio_tail, r[100].n_words_tail, r[0].symbol_ratio_tail) == ("high", None, None) and r[100].symbol_ratio_pct == 1
    wide = quality.language_sketches(odd.withColumn("symbol_ratio", F.col("doc_id") / 100))
    assert quality.tails(odd, wide).where("in_tail").count() == 0
    assert quality.tails(odd, quality.language_sketches(odd)).where("in_tail").count() == 1
    alone = odd.where("doc_id < 100").union(spark.createDataFrame([(200, "xx", 50.0, 5.0, 0.1, 0.0, 0.0, 1.0, JUNK[3])], odd.schema))
    assert [x.doc_id for x in quality.rate(alone, words).where("NOT is_prose").collect()] == [200]


def test_half_outside_sentences_is_no_prose(spark):
    words = spark.createDataFrame([("zh", w) for w in "在 有 但 是 不 需要".split()], "lang string, word string")
    prose = ["患者在第" + d + "天有不同的表现。\n" for d in "一二三四五六七八九"]
    rows = [(i, "zh", "".join(prose)) for i in range(40)] + [(100, "zh", "".join(prose[:3]) + "- 甲乙丙丁戊己庚辛壬癸甲乙丙\n" * 3), (101, "zh", "".join(prose[:4]) + "- 甲乙丙丁戊己庚辛壬癸甲乙\n" * 3)]
    df = spark.createDataFrame([*rows, (102, "zh", "患者在" + "".join(f"第{i}天有表现，" for i in range(40)) + "但是不需要。")], "doc_id long, lang string, text string")
    r = {x.doc_id: x for x in quality.rate(quality.text_stats(df, words), words).collect()}
    assert {i for i, x in r.items() if not x.is_prose} == {100} and r[101].in_tail


def test_common_words_are_bounded(spark):
    words = spark.range(quality.MOST_WORDS + 1).select(F.lit("zh").alias("lang"), F.concat(F.lit("w"), F.col("id")).alias("word"))
    with pytest.raises(ValueError):
        quality.common_words(words)


def test_statistics_of_one_text(spark):
    words = spark.createDataFrame([("en", "the"), ("zh", "在"), ("zh", "但是"), (None, None), ("zh", "")], "lang string, word string")
    rows = [(1, None, "The ab。\n在 c-d"), (2, "zh", "the 但是在甲"), (3, "en", "the 但是在甲"), (4, "fr", " \n"), (5, "zh", None), (6, "zh", "，，\n")]
    r = {x.doc_id: x for x in quality.text_stats(spark.createDataFrame(rows, "doc_id long, lang string, text string"), words).collect()}
    assert (r[1].n_words, r[1].symbol_ratio, r[1].punct_lines, r[1].bare_share) == (5.0, pytest.approx(2 / 10), 0.5, 0.0)
    assert r[1].mean_word_len == pytest.approx(8 / 5) and r[1].common_share == pytest.approx(2 / 5)
    assert r[2].common_share == pytest.approx(3 / 5) and r[3].common_share == pytest.approx(1 / 5)
    assert r[4].n_words is None and r[5].bare_share is None and (r[6].n_words, r[6].symbol_ratio, r[6].bare_share) == (0.0, 1.0, 1.0)
    assert 0 <= quality.ProseMeter(["the", "在"]).share("The ab。") <= 1


TEXTS = ["", None, "hello world", "<|endoftext|> x", "aaaaaaaaaaaaaaaa   \n\n  b", "我们" * 700, "𠀀𠀁 x", "\t\t  ", "I'll don't we've 123 ———/(&;~*", "─" * 40 + "┼" + "─" * 9, "é" * 31, " " * 50, "x" * 20_000]


def test_encoding_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    rnd = random.Random(1)
    texts = TEXTS + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0x4E00, 0x4F00), 32, 0x2014, 0xE9])) for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, 1, "v") for i, x in enumerate(texts)], "doc_id long, text string, k int, ids string")
    for chunk in (bpe.CHUNK_BYTES, 500):
        got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text", chunk_bytes=chunk).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, ["doc_id"], "text").collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip():
    m = bpe.Merges.load(bpe.DEFAULT_VOCABULARY)
    import json

    vocab = {v: k for k, v in json.load(open(bpe.DEFAULT_VOCABULARY, encoding="utf-8"))["model"]["vocab"].items()}
    back = {c: b for b, c in bpe.printable_bytes().items()}
    pieces = [x.encode() for x in TEXTS if x]
    ids, counts = bpe.encode_pieces(pieces, m)
    at = 0
    for p, n in zip(pieces, counts, strict=True):
        assert bytes(back[c] for i in ids[at : at + n] for c in vocab[int(i)]) == p
        at += n


def test_nfc_of_class_table():
    assert all(unicodedata.normalize("NFC", c) == c for c in "éáöü")
    assert F is not None


def test_long_texts_take_time_in_proportion(spark):
    long = ["甲" * 200_000, "甲" * 100_000 + "82.", "<" * 100_000 + "x", "标签：" + "甲；" * 50_000 + "。", "." * 100_000, "a. " * 60_000, "& " * 50_000, "甲。" * 60_000]
    texts = corpus(60) + long
    got = {r.doc_id: r.is_cut for r in truncation.truncated(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and got[60] and got[61]
    words = spark.createDataFrame([("zh", "的")], "lang string, word string")
    df = spark.createDataFrame([(i, "zh", t) for i, t in enumerate(long)], "doc_id long, lang string, text string")
    assert quality.rate(quality.text_stats(df, words), words).count() == len(long)
    assert canonical.canonicalize(values(spark, long)).count() == 0

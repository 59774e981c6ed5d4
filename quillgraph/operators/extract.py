"""Rule-based extraction, parsing of model answers, and their checks.

Model-backed layers plug in as functions from a batch of sentences to spans; everything after that is native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ontology
from ..functions import text
from ..runtime import materialize

# Lexicons of the rule layer.
LEXICON = {
    "Symptom": ("咳嗽", "喘息", "胸闷", "胸痛", "呼吸困难", "呼吸短促", "气急", "气促", "咳痰", "多痰", "发热", "头痛", "乏力", "嗜睡", "紫绀", "心悸", "恶心", "呕吐", "腹泻", "便秘", "失眠", "焦虑", "抑郁", "水肿", "皮疹", "鼻鼾", "打鼾"),
    "Drug": ("沙丁胺醇", "糖皮质激素", "皮质类固醇", "抗生素", "红霉素", "抗抑郁药", "镇静催眠药", "胰岛素", "布地奈德", "阿司匹林", "β2激动药", "β受体阻滞剂", "白三烯拮抗药", "硫酸镁"),
    "Treatment": ("戒烟", "康复治疗", "放射治疗", "化疗", "手术", "心理治疗", "肺移植", "吸氧", "接种疫苗", "药物治疗", "吸入治疗", "住院治疗", "静脉注射"),
    "Examination": ("呼吸量测定法", "肺功能检查", "肺功能测试", "CT检查", "核磁共振", "血常规", "基因检测", "医学筛查", "影像学检查"),
    "RiskFactor": ("吸烟", "空气污染", "过敏原", "基因", "遗传", "遗传因素", "感染", "病毒", "细菌", "高血压", "糖尿病", "肥胖", "饮酒", "压力", "环境因素", "血栓", "放射"),
}
RELATION_OF = {"Symptom": "HAS_SYMPTOM", "Drug": "TREATED_BY", "Treatment": "TREATED_BY", "Examination": "DIAGNOSED_BY", "RiskFactor": "HAS_RISK_FACTOR"}
# Templates of terms by their ending.
TEMPLATES = {"Examination": "([\\u4e00-\\u9fff]{2,10}(?:检查|测定法|检测|筛查))", "Treatment": "([\\u4e00-\\u9fff]{2,10}(?:治疗|疗法))"}


def lexicon_table(spark, lexicon: dict[str, tuple[str, ...]] = LEXICON) -> DataFrame:
    return spark.createDataFrame([(t, k) for k, ts in lexicon.items() for t in ts], "term string, type string")


def sentence_rows(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """``key, pos, sentence`` of the cleaned contents."""
    return docs.select(key, F.posexplode(text.sentences(text.blank_markup(F.col(content)))).alias("pos", "sentence"))


def contained_terms(sentences: DataFrame, terms: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """``key, pos, sentence, term, type``: every term of a bounded lexicon that a sentence contains.

    One automaton of all terms scans each sentence once, instead of a join on containment.
    """
    kind = dict(sentences.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for t, k in terms:
            automaton.add_word(t, (t, k))
        automaton.make_automaton()
        for b in batches:
            out = [(k, p, s, t, ty) for k, p, s in zip(b[key], b["pos"], b["sentence"], strict=True) for t, ty in sorted({v for _, v in automaton.iter(s)})]
            yield pd.DataFrame(out, columns=[key, "pos", "sentence", "term", "type"])

    return sentences.select(key, "pos", "sentence").mapInPandas(run, f"{key} {kind}, pos int, sentence string, term string, type string")


def first_sentences(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each term of a document the first sentence that holds it."""
    w = Window.partitionBy(key, "term", "type").orderBy("pos")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def template_terms(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, pos, sentence, term, type`` of terms by their endings, without those that swallowed function characters."""
    def made(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(1)), lambda t: F.struct(text.template_term(t).alias("term"), F.lit(kind).alias("type")))

    found = [made(k, p) for k, p in TEMPLATES.items()]
    return sentences.select(key, "pos", "sentence", F.explode(F.concat(*found)).alias("x")).select(key, "pos", "sentence", "x.term", "x.type").where("term IS NOT NULL")


def rule_facts(docs: DataFrame, terms: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """Facts of the rule layer: the title as Disease with lexicon hits (0.9) and template hits (0.7), never itself."""
    s = sentence_rows(docs, key)
    lex = first_sentences(contained_terms(s, terms, key), key).withColumn("confidence", F.lit(0.9))
    tpl = first_sentences(template_terms(s, key), key).withColumn("confidence", F.lit(0.7))
    best = lex.unionByName(tpl)
    rel = F.try_element_at(F.create_map(*(F.lit(x) for kv in RELATION_OF.items() for x in kv)), F.col("type"))
    t = docs.select(F.col(key).alias("_k"), text.squeeze(F.col("title")).alias("subject")).where("subject <> ''")
    return best.join(t, best[key] == t["_k"]).where("term <> subject").select(key, "subject", F.lit("Disease").alias("subject_type"), rel.alias("relation"), F.col("term").alias("object"), F.col("type").alias("object_type"), F.col("sentence").alias("source_text"), "confidence", F.lit("rule").alias("layer"))


ANSWER = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string,evidence:string>>"


def parse_answer(answer: Column) -> Column:
    """The first ``[ ... ]`` of a model's answer as items; NULL if it is no JSON list."""
    return F.from_json(F.nullif(F.regexp_extract(answer, "(?s)\\[.*\\]", 0), F.lit("")), ANSWER)


def answer_facts(answers: DataFrame, answer: str, content: str, key: str) -> DataFrame:
    """Facts of model answers: names and types resolved, valid by the ontology, evidence found in the content."""
    items = answers.select(key, F.col(content).alias("_content"), F.explode(parse_answer(F.col(answer))).alias("i")).select(key, "_content", "i.*")
    s, o = text.strip(F.col("subject")), text.strip(F.col("object"))
    st, ot, r = ontology.resolve_type(F.col("subject_type")), ontology.resolve_type(F.col("object_type")), ontology.resolve_relation(F.col("relation"))
    ok = (s != "") & (o != "") & st.isNotNull() & ot.isNotNull() & r.isNotNull()
    ok = ok & ontology.fits(r, st, ot) & text.supported(F.col("evidence"), F.col("_content"))
    return items.where(ok).select(key, s.alias("subject"), st.alias("subject_type"), r.alias("relation"), o.alias("object"), ot.alias("object_type"), F.col("evidence").alias("source_text"), F.lit(0.8).alias("confidence"), F.lit("llm").alias("layer"))


def tag_spans(sentences: DataFrame, tagger: Callable[[pd.Series], pd.Series], key: str = "doc_id") -> DataFrame:
    """Spans of a pluggable tagger: a function from sentences to lists of (term, type, confidence, start, end)."""
    kind = "array<struct<term:string,type:string,confidence:double,start:int,end:int>>"
    return sentences.select(key, "pos", "sentence", F.explode(F.pandas_udf(tagger, kind)("sentence")).alias("s")).select(key, "pos", "sentence", "s.*")


def lexicon_tagger(lexicon: dict[str, tuple[str, ...]] = LEXICON) -> Callable[[pd.Series], pd.Series]:
    """A tagger without a model: lexicon terms (0.9), and template terms and names that end like diseases, without function characters (0.7)."""
    terms = [(t, k) for k, ts in lexicon.items() for t in ts]
    patterns = {"Disease": "([\\u4e00-\\u9fff]{1,10}(?:" + "|".join(text.DISEASE_ENDS) + "))", **TEMPLATES}
    noise = "[" + text.TEMPLATE_NOISE + "]"

    def tag(sentences: pd.Series) -> pd.Series:
        automaton = ahocorasick.Automaton()
        for t, k in terms:
            automaton.add_word(t, (t, k))
        automaton.make_automaton()
        n = re.compile(noise)

        def spans(x: str) -> list[dict]:
            out = [(t, k, 0.9, end - len(t) + 1, end + 1) for end, (t, k) in automaton.iter(x)]
            out += [(m[1], k, 0.7, m.start(1), m.end(1)) for k, p in patterns.items() for m in re.finditer(p, x) if not n.search(m[1])]
            return [dict(zip(("term", "type", "confidence", "start", "end"), s, strict=True)) for s in out]

        return sentences.map(spans)

    return tag


def pair_spans(spans: DataFrame, key: str = "doc_id", titles: DataFrame | None = None) -> DataFrame:
    """Disease and other spans of a sentence, paired within a clause where there is one, else within the sentence.

    Where a sentence names no disease, the title of ``titles`` (key, title; one row per key) is the subject with
    confidence 0.8 if it is a disease name. A subject equal to its object is dropped, as are types without a relation.
    """
    cl = F.filter(text.clauses(F.col("sentence")), lambda c: c["start"] <= F.col("start"))
    s = spans.withColumn("clause", F.coalesce(F.array_max(F.transform(cl, lambda c: c["start"])), F.lit(0)))
    d = s.where("type = 'Disease'").select(key, "pos", F.col("term").alias("subject"), F.col("start").alias("s_start"), F.col("clause").alias("s_clause"), F.col("confidence").alias("s_conf"))
    o = s.where(F.col("type").isin(*RELATION_OF) & (F.col("term") != "")).select(key, "pos", F.col("term").alias("object"), F.col("type").alias("object_type"), F.col("start").alias("o_start"), F.col("clause").alias("o_clause"), F.col("confidence").alias("o_conf"))
    prio = F.when(F.col("s_clause") == F.col("o_clause"), 1).when(F.col("s_clause").isNotNull(), 2).otherwise(3)
    pairs = o.join(d, [key, "pos"], "left").withColumn("prio", prio)
    if titles is not None:
        name = text.strip(F.col("title"))
        t = titles.select(F.col(key).alias("_k"), name.alias("_title")).where(text.is_disease_title(F.col("_title")))
        pairs = pairs.join(t, (F.col(key) == F.col("_k")) & (F.col("prio") == 3), "left")
        pairs = pairs.withColumn("subject", F.coalesce("subject", "_title")).withColumn("s_conf", F.coalesce("s_conf", F.lit(0.8)))
    w = Window.partitionBy(key, "pos", "o_start", "object", "object_type").orderBy("prio")
    pairs = pairs.where("subject IS NOT NULL").withColumn("_r", F.dense_rank().over(w)).where("_r = 1 AND subject <> object")
    rel = F.try_element_at(F.create_map(*(F.lit(x) for kv in RELATION_OF.items() for x in kv)), F.col("object_type"))
    return pairs.select(key, "pos", "subject", "object", "object_type", F.round(F.col("s_conf") * F.col("o_conf"), 4).alias("confidence"), rel.alias("relation"))


# Terms that a span model finds by mistake, and names that are no symptoms.
NOISE_TERMS = (
    "服用", "使用", "应用", "治疗", "预防", "诊断", "检测", "检查", "感染", "出现", "发生", "导致", "引起", "造成", "表现", "患者",
    "病人", "症状", "体征", "药物", "药品", "用药", "护理", "维生素",
    "成年人", "成人", "儿童", "小孩", "老年人", "老人", "青少年", "婴儿", "女性", "男性", "人群", "患者群",
)
NO_SYMPTOMS = ("死亡", "死亡率", "發病", "發病率", "病死", "病死率", "疫情", "傳染", "爆發", "大流行", "患病人數", "病例", "確診", "治癒", "康復")


def span_confidence(probabilities: Column, start: Column, end: Column) -> Column:
    """Mean probability of a span's characters [start, end), rounded to four digits."""
    part = F.slice(probabilities, start + 1, F.greatest(end - start, F.lit(0)))
    return F.round(F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.size(part)), 4)


def kept_spans(spans: DataFrame, docs: DataFrame, key: str = "doc_id", lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Spans without noise: Latin words that the title lacks, general terms, names that are no symptoms and terms that
    don't fit their type are left out, filler at the end is taken off. Documents without a title give none."""
    titles = docs.select(F.col(key).alias("_k"), text.stripped(F.col("title")).alias("_title")).where("_title <> ''")
    s = spans.join(titles, F.col(key) == F.col("_k")).drop("_k")
    foreign = text.is_latin_word(F.col("term")) & ~F.contains("_title", "term")
    s = s.where(~foreign & ~F.col("term").isin(*NOISE_TERMS)).drop("_title").withColumn("term", text.strip_filler(F.col("term")))
    return s.where((F.col("term") != "") & ~((F.col("type") == "Symptom") & F.col("term").isin(*NO_SYMPTOMS)) & text.plausible(F.col("term"), F.col("type"), lexicon))


def sure_spans(kept: DataFrame, min_length: int = 2, threshold: float = 0.7) -> DataFrame:
    """``kept`` with ``sure``: long and confident enough to make facts; the others only tell that a sentence has entities."""
    return kept.withColumn("sure", (F.length("term") >= min_length) & (F.col("confidence") >= threshold))


def span_layer(spans: DataFrame, docs: DataFrame, key: str = "doc_id", min_length: int = 2, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(facts, routed sentences) of a span model: sure spans are paired by clause, sentence or title; a sentence with
    spans that gives no fact is routed to the next layer, each different sentence of a document once. Spans are written
    once, so the model sees a sentence once, not for every use of its spans."""
    spans = materialize(sure_spans(kept_spans(spans, docs, key), min_length, threshold), "kept-spans")
    facts = pair_spans(spans.where("sure").drop("sure"), key, docs.select(key, "title")).where("relation IS NOT NULL")
    signs = spans.groupBy(key, "pos").agg(F.min("sentence").alias("sentence"))
    routed = signs.join(facts.select(key, "pos").distinct(), [key, "pos"], "left_anti")
    return facts, routed.groupBy(key, "sentence").agg(F.min("pos").alias("pos"))


# What shows in a sentence that it states a relation, with the relation's kinds of terms.
TRIGGERS = {
    "常见症状": (["(?:症状|征状|表现)(?:包括|有|为|是|主要是|常见的)?", "出现", "伴随"], [("Symptom", "症状")]),
    "治疗": (["(?:治疗|处理)(?:包括|采用|使用|给予|可用|方法为)?", "通过.+治疗"], [("Drug", "药物"), ("Treatment", "治疗方法")]),
    "病因": (["(?:病因|原因|因素)(?:包括|是|为)?", "(?:由|因|因为).{0,8}(?:导致|造成|引起)"], [("Cause", "疾病")]),
    "不良反应": (["(?:不良反应|副作用)(?:包括|有|为)?", "可引起"], [("Symptom", "症状")]),
    "检查方法": (["(?:检查|诊断)(?:包括|基于|采用|可通过|通常基于)?", "检测", "测定"], [("Examination", "检查方法")]),
}


def ordered_terms(terms: Column) -> Column:
    """Different terms, the longest first, then by code point."""
    keyed = F.transform(F.array_distinct(terms), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def trigger_facts(docs: DataFrame, terms: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """``key, document_id, pos, subject, relation, object, object_type, source_text``: the title with every term of a
    relation's kinds in the sentences that hold one of its triggers.

    Needs title, content, document_id and a category. Of equal facts of all documents the first in the order of
    document, sentence, relation and term (longest first) is kept; a fact is never about itself.
    """
    whole = (text.squeeze(F.col("title")) != "") & (text.squeeze(F.col("document_id")) != "") & F.coalesce(F.regexp_like("category_ids", F.lit("[\\p{L}\\p{N}]")), F.lit(False))
    d = docs.where(whole).select(key, "document_id", text.squeeze(F.col("title")).alias("title"), F.posexplode(text.plain_sentences(text.squeeze(F.col("content")))).alias("pos", "sentence"))
    hits = contained_terms(d.select(key, "pos", "sentence"), terms, key)
    made = []
    for rank, (relation, (patterns, kinds)) in enumerate(TRIGGERS.items()):
        for k, (kind, label) in enumerate(kinds):
            shown = (F.col("type") == kind) & F.col("sentence").rlike("(?i)" + "|".join(patterns))
            made.append(F.when(shown, F.struct(F.lit(rank).alias("rank"), F.lit(k).alias("k"), F.lit(relation).alias("relation"), F.lit(label).alias("object_type"))))
    f = hits.withColumn("f", F.explode(F.array_compact(F.array(*made)))).join(d.select(key, "document_id", "title").distinct(), key)
    f = f.where("term <> title").select(key, "document_id", "pos", F.col("title").alias("subject"), "f.relation", F.col("term").alias("object"), "f.object_type", F.col("sentence").alias("source_text"), F.struct(F.col(key), F.col("pos"), F.col("f.rank"), F.col("f.k"), (-F.length("term")).alias("n"), F.col("term").alias("t")).alias("_at"))
    w = Window.partitionBy("subject", "relation", "object", "object_type").orderBy("_at")
    return f.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_at")


def labelled(facts: DataFrame) -> DataFrame:
    """Facts with the labels of their types and relation beside the ids."""
    return facts.withColumns({
        "subject_type_label": ontology.type_label(F.col("subject_type")),
        "relation_label": ontology.relation_label(F.col("relation")),
        "object_type_label": ontology.type_label(F.col("object_type")),
    })


def sentences_of(sentences: Column, content: Column) -> Column:
    """The stored sentences of a document, or those of its content where there are none."""
    return F.when(F.coalesce(F.size(sentences), F.lit(0)) > 0, sentences).otherwise(text.sentences(F.coalesce(content, F.lit(""))))


def asked(sentences: DataFrame, ask, key: str = "doc_id", attempts: int = 3) -> DataFrame:
    """``key, answer, calls``: answers of a pluggable model, a function from (prompt, last fault or None) to text.

    An answer that holds no JSON list is asked for again with its fault, up to ``attempts`` times; then it is an empty
    list. Calls are counted in the result, so a lost executor's repeats count for what they are.
    """
    kind = dict(sentences.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for k, prompt in zip(b[key], b["prompt"], strict=True):
                fault, answer, calls = None, "[]", 0
                while calls < attempts:
                    calls += 1
                    said = ask(prompt, fault)
                    found = re.search(r"\[.*\]", said or "", re.S)
                    try:
                        if found and isinstance(json.loads(found[0]), list):
                            answer = found[0]
                            break
                        fault = "no JSON list"
                    except ValueError as e:
                        fault = str(e)
                out.append((k, answer, calls))
            yield pd.DataFrame(out, columns=[key, "answer", "calls"])

    return sentences.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, calls int")

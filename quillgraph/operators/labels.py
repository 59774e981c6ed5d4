"""Character labels of sentences, their evaluation and the training sets made of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def places(sentence: str, term: str) -> list[int]:
    """Where ``term`` begins in ``sentence``, overlapping places included."""
    return [m.start() for m in re.finditer(f"(?={re.escape(term)})", sentence)] if term else []


def _put(labels: list[str], at: int, size: int, kind: str) -> None:
    labels[at : at + size] = ["B-" + kind] + ["I-" + kind] * (size - 1)


def _is_free(labels: list[str], at: int, size: int) -> bool:
    return set(labels[at : at + size]) == {"O"}


def mark_terms(sentence: str, terms: list[tuple[str, str]]) -> list[str]:
    """B-/I- labels of the terms, longest first, only where all characters are free; O elsewhere."""
    labels = ["O"] * len(sentence)
    for term, kind in sorted(terms, key=lambda t: (-len(t[0]), t[0], t[1])):
        for at in places(sentence, term):
            if _is_free(labels, at, len(term)):
                _put(labels, at, len(term), kind)
    return labels


def label_sentences(sentences: DataFrame, terms: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """``key, pos, sentence, labels`` by a bounded lexicon, longest terms first."""
    kind = dict(sentences.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for t in terms:
            if t[0]:
                automaton.add_word(t[0], t)
        automaton.make_automaton()
        for b in batches:
            # one scan finds the terms a sentence holds; only these are marked
            marked = [mark_terms(s, sorted({t for _, t in automaton.iter(s)}) if len(automaton) else []) for s in b["sentence"]]
            yield pd.DataFrame({key: b[key], "pos": b["pos"], "sentence": b["sentence"], "labels": marked})

    return sentences.select(key, "pos", "sentence").mapInPandas(run, f"{key} {kind}, pos int, sentence string, labels array<string>")


def spans_of(labels: Column) -> Column:
    """Spans (start, end, type) of B-/I- labels; an I- without its B- gives none."""
    step = lambda a, x: F.struct(
        (a["i"] + 1).alias("i"),
        F.when(x.startswith("B-"), F.concat(a["out"], F.array(F.struct(a["i"].alias("start"), (a["i"] + 1).alias("end"), F.substr(x, F.lit(3)).alias("type")))))
        .when(
            x.startswith("I-") & (F.size(a["out"]) > 0) & (F.try_element_at(a["out"], F.lit(-1))["end"] == a["i"]) & (F.try_element_at(a["out"], F.lit(-1))["type"] == F.substr(x, F.lit(3))),
            F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(F.try_element_at(a["out"], F.lit(-1))["start"].alias("start"), (a["i"] + 1).alias("end"), F.try_element_at(a["out"], F.lit(-1))["type"].alias("type")))),
        )
        .otherwise(a["out"])
        .alias("out"),
    )
    zero = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int,type:string>>").alias("out"))
    return F.aggregate(labels, zero, step)["out"]


def precision_recall(pairs: DataFrame, gold: str = "gold", found: str = "found", by: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averaged precision, recall and F1 of arrays of spans; 0 where a denominator is 0."""
    hit = F.size(F.array_intersect(gold, found))
    s = pairs.groupBy(*by).agg(F.sum(hit).alias("tp"), F.sum(F.size(F.array_except(found, gold))).alias("fp"), F.sum(F.size(F.array_except(gold, found))).alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def threshold_grid(docs: DataFrame, min_lens: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """``min_len, threshold, tp, fp, fn, precision, recall, f1, kept, routed`` of every pair of bounds, in one pass.

    ``docs`` has ``gold`` (set of spans) and ``spans`` (array of span, size, confidence) of a document or sentence. A
    span is kept if it is long and confident enough; ``routed`` is the number of rows with gold and an unsure span over
    the number of gold spans. The grid is a bounded array, so no row is read twice.
    """
    grid = F.array(*(F.struct(F.lit(m).alias("min_len"), F.lit(c).alias("threshold")) for m in min_lens for c in thresholds))
    rows = docs.select("gold", "spans", F.explode(grid).alias("g")).select("gold", "spans", "g.*")
    ok = lambda x: (x["size"] >= F.col("min_len")) & (x["confidence"] >= F.col("threshold"))
    kept = F.filter("spans", ok)
    rows = rows.withColumn("found", F.array_distinct(F.transform(kept, lambda x: x["span"]))).withColumn("n_kept", F.size(kept))
    unsure = (F.size("spans") > F.col("n_kept")) & (F.size("gold") > 0)
    hit = F.size(F.array_intersect("gold", "found"))
    out = rows.groupBy("min_len", "threshold").agg(
        F.sum(hit).alias("tp"),
        F.sum(F.size("found") - hit).alias("fp"),
        F.sum(F.size("gold") - hit).alias("fn"),
        F.sum("n_kept").alias("kept"),
        (F.count_if(unsure) / F.greatest(F.sum(F.size("gold")), F.lit(1))).alias("routed"),
    )
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def majority(votes: DataFrame, pos: str, least: int = 2) -> DataFrame:
    """``term, type, n``: the commonest type of each term, of equals the first seen, with ``least`` votes or more."""
    by = votes.groupBy("term", "type").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    best = by.groupBy("term").agg(F.max_by(F.struct("type", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("term", "b.type", "b.n").where(F.col("n") >= least)


def class_weights(labels: DataFrame) -> DataFrame:
    """``label, n, weight``: total over count, 1 for O."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("label", "n", F.when(F.col("label") == "O", 1.0).otherwise(F.col("total") / F.greatest("n", F.lit(1))).alias("weight"))


def append_unseen(train: DataFrame, more: DataFrame, key: str = "sentence") -> DataFrame:
    """``train`` and the rows of ``more`` with a key it lacks, one per key."""
    return train.unionByName(more.join(train.select(key), key, "left_anti").dropDuplicates([key]).select(train.columns))


def hash_split(df: DataFrame, key: str, seed: int = 17) -> DataFrame:
    """``part`` train, dev or test (8:1:1) by the key's hash: the same rows on every run."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10))
    return df.withColumn("part", F.when(h < 8, "train").when(h == 8, "dev").otherwise("test"))


# Types that a span model learns, and the corpus' names of them.
SPAN_TYPES = ("Disease", "Symptom", "Drug", "Treatment", "Examination", "RiskFactor")
GOLD_TYPES = {"dis": "Disease", "sym": "Symptom", "dru": "Drug", "pro": "Treatment", "equ": "Examination", "ite": "Examination"}


def gold_labels(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """B-/I- labels of annotated spans whose ends are inclusive; one that begins in another is left out."""
    labels = ["O"] * len(text)
    for start, last, kind in spans:
        kind = GOLD_TYPES.get(kind, "")
        if kind and 0 <= start <= last < len(text) and labels[start] == "O":
            labels[start : last + 1] = ["B-" + kind] + ["I-" + kind] * (last - start)
    return labels


def mark_once(labels: list[str], sentence: str, term: str, kind: str) -> bool:
    """Label the first place of ``term`` whose characters are all free, in ``labels``; whether there is one."""
    free = [at for at in places(sentence, term) if _is_free(labels, at, len(term))]
    if free:
        _put(labels, free[0], len(term), kind)
    return bool(free)


def weak_labels(sentence: str, terms: list[tuple[str, str]]) -> list[str]:
    """Labels of lexicon hits in the given order of terms: a hit needs a free first character, its others fill free places."""
    labels = ["O"] * len(sentence)
    for term, kind in terms:
        for m in re.finditer(re.escape(term), sentence) if term else ():
            own = ["B-" + kind] + ["I-" + kind] * (len(term) - 1)
            if labels[m.start()] == "O":
                labels[m.start() : m.end()] = [mine if there == "O" else there for mine, there in zip(own, labels[m.start() : m.end()], strict=True)]
    return labels


def weak_dataset(sentences: DataFrame, terms: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """``key, pos, sentence, labels`` of the sentences with a lexicon hit (order: types as given, longer terms first)."""
    kind = dict(sentences.dtypes)[key]
    kinds = list(dict.fromkeys(k for _, k in terms))
    ordered = sorted((t for t in terms if t[0]), key=lambda t: (kinds.index(t[1]), -len(t[0]), t[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for i, (t, _) in enumerate(ordered):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for b in batches:
            hits = [sorted({i for _, i in automaton.iter(s)}) for s in b["sentence"]]
            b = b.assign(labels=[weak_labels(s, [ordered[i] for i in h]) for s, h in zip(b["sentence"], hits, strict=True)])
            yield b[[bool(h) for h in hits]]

    return sentences.where("sentence <> ''").select(key, "pos", "sentence").mapInPandas(run, f"{key} {kind}, pos int, sentence string, labels array<string>")


def gold_dataset(corpus: DataFrame, text: str = "text", entities: str = "entities", most_chars: int = 500) -> DataFrame:
    """``sentence, labels`` of an annotated corpus (entities: array of start, end (inclusive), type): no text longer
    than a model takes, none without a label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [gold_labels(t, [(e["start"], e["end"], e["type"]) for e in es]) for t, es in zip(b["sentence"], b["e"], strict=True)]
            out = pd.DataFrame({"sentence": b["sentence"], "labels": made})
            yield out[[any(x != "O" for x in m) for m in made]]

    src = corpus.select(F.col(text).alias("sentence"), F.coalesce(entities, F.array().cast("array<struct<start:int,end:int,type:string>>")).alias("e"))
    return src.where(F.length("sentence").between(1, most_chars)).mapInPandas(run, "sentence string, labels array<string>")


def review_dataset(kept: DataFrame) -> DataFrame:
    """``sentence, labels, source_ids`` of facts that reviewers kept: their subjects and objects marked in the evidence.

    Facts with a type a span model doesn't learn, or without evidence, are left out. Facts of one sentence are marked
    in the order of their ids, the longer name of each first; a fact counts as a source if one of its names was marked.
    Equal facts of a sentence are gathered first, so a sentence's list holds its different facts with their ids.
    """
    s = F.btrim("source_text")
    t = kept.where(F.col("subject_type").isin(*SPAN_TYPES) & F.col("object_type").isin(*SPAN_TYPES)).where(s != "")
    facts = t.groupBy(s.alias("sentence"), F.coalesce("subject", F.lit("")).alias("subject"), "subject_type", F.coalesce("object", F.lit("")).alias("object"), "object_type").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))
    lists = facts.groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("id", "subject", "subject_type", "object", "object_type", "ids"))).alias("facts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made, sources = [], []
            for sentence, facts_ in zip(b["sentence"], b["facts"], strict=True):
                labels, ids = ["O"] * len(sentence), []
                for f in facts_:
                    names = sorted(((f["subject"], f["subject_type"]), (f["object"], f["object_type"])), key=lambda x: -len(x[0]))
                    # both names are tried
                    if sum(mark_once(labels, sentence, n, k) for n, k in names):
                        ids += list(f["ids"])
                made.append(labels)
                sources.append(sorted(ids))
            yield pd.DataFrame({"sentence": b["sentence"], "labels": made, "source_ids": sources})

    return lists.mapInPandas(run, "sentence string, labels array<string>, source_ids array<long>")


def review_skips(kept: DataFrame) -> DataFrame:
    """``reason, n``: kept facts that give no training data, by type or for want of evidence."""
    learned = F.col("subject_type").isin(*SPAN_TYPES) & F.col("object_type").isin(*SPAN_TYPES)
    kinds = F.concat(F.coalesce("subject_type", F.lit("?")), F.lit("/"), F.coalesce("object_type", F.lit("?")))
    reason = F.when(~F.coalesce(learned, F.lit(False)), kinds).when(F.coalesce(F.btrim("source_text"), F.lit("")) == "", "no evidence")
    return kept.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def label_histogram(labelled: DataFrame) -> DataFrame:
    """``type, n``: characters of each type in ``labels``."""
    chars = labelled.select(F.explode("labels").alias("x")).where("x <> 'O'")
    return chars.groupBy(F.substr("x", F.lit(3)).alias("type")).agg(F.count("*").alias("n"))


def token_labels(labels: Column, offsets: Column) -> Column:
    """Labels of tokens (array of start, end) from those of characters: B- where the type begins or changes, I- inside.

    A token takes the type of its first character; empty tokens (special signs) are ignored (NULL).
    """
    at = lambda i: F.when(i >= 0, F.get(labels, i))
    kind = lambda x: F.when(F.coalesce(x, F.lit("O")) != "O", F.substr(x, F.lit(3)))

    def one(o: Column) -> Column:
        here, before = kind(at(o["start"])), kind(at(o["start"] - 1))
        starts = ~here.eqNullSafe(before)
        return F.when(o["start"] >= o["end"], F.lit(None).cast("string")).when(here.isNull(), "O").otherwise(F.concat(F.when(starts, "B-").otherwise("I-"), here))

    return F.transform(offsets, one)


def char_labels(token_labels_: Column, offsets: Column, length: Column) -> Column:
    """Labels of ``length`` characters from those of tokens; characters of no token are O."""
    whole = F.arrays_zip(offsets.alias("o"), token_labels_.alias("l"))
    spread = lambda x: F.when(
        x["o"]["end"] > x["o"]["start"],
        F.transform(F.sequence(x["o"]["start"], x["o"]["end"] - 1), lambda i: F.struct(i.alias("i"), F.when(i > x["o"]["start"], F.regexp_replace(x["l"], "^B-", "I-")).otherwise(x["l"]).alias("l"))),
    )
    pairs = F.map_from_entries(F.flatten(F.filter(F.transform(whole, spread), lambda a: a.isNotNull())))
    return F.when(length <= 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit("O"))))

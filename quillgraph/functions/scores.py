"""Scores of documents and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int) -> Column:
    """Rounded half up on the binary value, as other engines do it."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def clean_confidence(length: Column, cjk: Column, sentences: Column, title: Column) -> Column:
    """How well a text was cleaned: its length, share of Chinese, sentences and title."""
    score = F.when(length >= 120, 0.35).when(length >= 60, 0.20).otherwise(0.05)
    score = score + F.lit(0.30) * F.least(cjk / 0.9, F.lit(1.0))
    score = score + F.when(sentences >= 2, 0.20).when(sentences == 1, 0.10).otherwise(0.0)
    score = score + F.when(title != "", 0.15).otherwise(0.0)
    return half_up(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4)


def confidence_level(score: Column, high: float = 0.75, medium: float = 0.50, names: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    return F.when(score >= high, names[0]).when(score >= medium, names[1]).otherwise(names[2])


def fact_score(base: Column, docs: Column, text_length: Column, mismatch: Column, conflict: Column) -> Column:
    """Confidence of a fact from its extraction, support, evidence and types."""
    base = F.when(base.isNull() | base.isin(0.0, 0.72), 0.78).otherwise(base)
    support = F.when(docs > 0, F.least(F.lit(1.0), 0.55 + 0.12 * F.least(docs, F.lit(4)))).otherwise(0.0)
    evidence = F.when(text_length > 0, F.least(F.lit(1.0), 0.35 + text_length / 70)).otherwise(0.0)
    score = 0.30 * base + 0.25 * support + F.lit(0.20) * 0.8 + 0.15 * evidence + 0.10 * F.when(mismatch, 0.45).otherwise(1.0)
    score = score - F.when(conflict, 0.15).otherwise(0.0)
    score = F.when((docs == 0) | (text_length == 0), F.least(score, F.lit(0.59))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), half_up(score, 3)))


def relevance(source: Column, in_title: Column, elsewhere: Column, length: Column, verified: Column) -> Column:
    """Relevance from the number of matched terms in the title and elsewhere."""
    score = F.when(source == "mediawiki", 0.48).otherwise(0.58) + 0.20 * in_title + 0.08 * elsewhere + F.when(length >= 200, 0.06).otherwise(0.0)
    return F.when(verified, 0.98).otherwise(half_up(F.least(score, F.lit(0.95)), 2))


def document_quality(title_length: Column, length: Column, has_authors: Column, relevant: Column) -> Column:
    score = 0.25 + F.least(title_length / 100, F.lit(0.15)) + F.least(length / 1200, F.lit(0.30)) + F.when(has_authors, 0.10).otherwise(0.0) + relevant * 0.20
    return half_up(F.least(score, F.lit(0.99)), 2)


def sample_quality(title: Column, content: Column) -> Column:
    score = 0.55 + F.when(F.length(title) >= 2, 0.15).otherwise(0.0) + F.when(F.length(content) >= 180, 0.25).when(F.length(content) >= 80, 0.15).otherwise(0.0)
    return half_up(F.least(score, F.lit(0.99)), 2)

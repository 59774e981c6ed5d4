r"""Texts cut off before the end of their last sentence, in pure SQL.

Tokens are Latin words, numbers (all alike, a decimal's parts and point each), single Han characters and single marks.
Word trigrams are counted inside texts and at their ends; the final trigram of each text joins these counts, and a text
is cut where its final trigram is frequent inside texts but almost never terminal. A last word may be torn, so inside a
text every trigram also counts for the beginnings of its last word that end some text.

The share of a trigram's occurrences that are terminal leaves the text itself out and is smoothed by the share of its
last two tokens as prior, this by that of its last token, this by that of the token's class: ``weight`` occurrences of
the prior are added at each level, so the trigram decides where it is known and its suffix where it is new. Texts that
are equal count once, so copies of a cut text do not make its end a common one.

What stands in place of the rest after a cut (dots, ellipsis, replacement sign, opened tag or entity, a bracketed
pointer to the full text) is taken off first. A keyword line (label, colon, list without a sentence end) and a
bracketed note after a finished sentence close a text and are no cut.

Defined cases: NULL, empty, blank and placeholder texts (no sentence, or one of the fixed placeholders) are no cases;
ties in doc_id are separate rows; texts of one or two tokens use their bigram or last token; a bracketed pointer may be of any length without a sentence mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..runtime import finished, materialize

# What may stand after a cut. All patterns take time in proportion to the text.
CUT_MARKS = r"(?:\s?(?:(?<!…)…++|(?<!。)。{2,}+|(?<!\.)\.{2,}+|(?<!\x{FFFD})\x{FFFD}++|[\[【][^\[\]【】。.！!？?]++[\]】]|(?<!&)&#?\w{0,8}+;?|(?<!<)<\/?\w{0,8}+\/?>?)){1,8}+\s?$"
TOKEN = r"\p{IsLatin}[\p{IsLatin}\p{M}]*+|[^\s]"
END = r"[。．.！!？?…]"
KEYWORD_LINE = r"(?:^|[。．.！!？?…”’\"'）)\]】\n])\s*(?:[^，。；;：:、“”\"()（）\s][^，。；;：:、“”\"()（）]{1,11}[:：](?=[^。！!？?“”\"]*+$)[^；;|｜、,，]*[；;|｜、,，]|(?i:关键词|关键字|主题词|key\s?words?)\s*[:：](?=[^。！!？?]*+$))"
BRACKET_NOTE = r"(?:^|[。．.！!？?…”’\"'])\s*(?:（[^（）]*[）)]|\([^()]*[)）]|【[^【】]*】|\[[^\[\]]*\])\s*$"
# Texts that stand for a missing one.
PLACEHOLDER = r"^[（(\[【]?\s*(?i:内容待补|本条目正在整理|暂无简介|暂无摘要|暂无内容|暂无|无|待补充?|no abstract available|not available|n/?a|none|null|todo|tbd|-+)\s*[。.）)\]】]*$"


def bodies(docs: DataFrame, value: str = "content") -> DataFrame:
    """``doc_id, source, closed, h, row, t``: the texts that can be cut, by their tokens without marks of a cut.

    ``closed`` texts end with a keyword line or a bracketed note, so their last tokens end no sentence. ``h`` is equal
    for equal texts, ``row`` names each row once it is written.
    """
    return docs.sparkSession.sql(
        """
        WITH texts AS (SELECT doc_id, source, trim(regexp_replace(content, :blank, ' ')) AS content FROM {docs}),
        bodies AS (
          SELECT doc_id, source, content, regexp_replace(content, :cut_marks, '') AS body
          FROM texts WHERE content <> '' AND NOT content RLIKE :placeholder
        )
        SELECT doc_id, source, body RLIKE :keyword_line OR content RLIKE :bracket_note AS closed, xxhash64(content) AS h, monotonically_increasing_id() AS row,
               regexp_extract_all(regexp_replace(body, :number, '0'), :token, 0) AS t
        FROM bodies
        """,
        args={"blank": r"[\s\p{Z}]+", "cut_marks": CUT_MARKS, "placeholder": PLACEHOLDER, "token": TOKEN, "number": r"\p{Nd}++", "keyword_line": KEYWORD_LINE, "bracket_note": BRACKET_NOTE},
        docs=docs.select("doc_id", "source", docs[value].cast("string").alias("content")),
    )


def gram_counts(texts: DataFrame) -> DataFrame:
    """``w1, w2, w3, n, ends``: how often each token trigram stands inside texts, and how often at an end.

    Texts begin with two empty tokens, so every token is the last of one trigram.
    """
    return texts.sparkSession.sql(
        """
        SELECT g.w1, g.w2, g.w3, count(*) AS n, count_if(g.last) AS ends
        FROM (
          SELECT explode(transform(sequence(0, size(t) - 1), i -> named_struct(
                   'w1', CASE WHEN i >= 2 THEN t[greatest(i - 2, 0)] ELSE '' END,
                   'w2', CASE WHEN i >= 1 THEN t[greatest(i - 1, 0)] ELSE '' END,
                   'w3', t[i], 'last', NOT closed AND i = size(t) - 1))) AS g
          FROM {texts} WHERE size(t) > 0)
        GROUP BY g.w1, g.w2, g.w3
        """,
        texts=texts,
    )


def _kind(w: str) -> str:
    """SQL of the class of a last token: a Latin word, a Han character, or the mark itself."""
    return f"CASE WHEN {w} RLIKE :latin THEN 'word' WHEN {w} RLIKE :han THEN 'sign' ELSE {w} END"


def final_grams(counts: DataFrame, ended: DataFrame) -> DataFrame:
    """``w1, w2, w3, n, ends`` of the trigrams whose last token ends some text.

    Inside occurrences of a Latin word count for each of its beginnings as well, as a torn word is one.
    """
    return counts.sparkSession.sql(
        """
        WITH lasts AS (SELECT DISTINCT w3 FROM {ended}),
        spelled AS (
          SELECT w1, w2, w3, n, ends FROM {counts}
          UNION ALL
          SELECT w1, w2, explode(transform(sequence(1, length(w3) - 1), k -> left(w3, k))) AS w3, n, 0 AS ends
          FROM {counts} WHERE w3 RLIKE :latin AND length(w3) > 1
        )
        SELECT w1, w2, w3, sum(n) AS n, sum(ends) AS ends FROM spelled LEFT SEMI JOIN lasts USING (w3) GROUP BY w1, w2, w3
        """,
        args={"latin": r"^\p{IsLatin}"},
        counts=counts,
        ended=ended,
    )


def truncated(docs: DataFrame, value: str = "content", weight: int = 100, max_terminal: float = 0.03) -> DataFrame:
    """``doc_id, source, terminal, is_cut`` of every text that can be cut; terminal shares under ``max_terminal`` mean a cut."""
    spark = docs.sparkSession
    # tokens and counts are written once: both are used several times below
    texts = materialize(bodies(docs, value), "text-tokens")
    once = spark.sql("SELECT t.closed, t.t FROM {texts} t LEFT SEMI JOIN (SELECT min(row) AS row FROM {texts} GROUP BY h) f ON t.row = f.row", texts=texts)
    counts = materialize(gram_counts(once), "gram-counts")
    ended = spark.sql(
        """
        SELECT doc_id, source, coalesce(get(t, size(t) - 3), '') AS w1, coalesce(get(t, size(t) - 2), '') AS w2, coalesce(get(t, size(t) - 1), '') AS w3
        FROM {texts} WHERE NOT closed AND size(t) > 0
        """,
        texts=texts,
    )
    known = materialize(final_grams(counts, ended), "final-grams")
    judged = spark.sql(
        f"""
        WITH tri AS (SELECT w1, w2, w3, n, ends FROM {{known}}),
        bi AS (SELECT w2, w3, sum(n) AS n, sum(ends) AS ends FROM tri GROUP BY w2, w3),
        uni AS (SELECT w3, sum(n) AS n, sum(ends) AS ends FROM bi GROUP BY w3),
        cls AS (SELECT {_kind('w3')} AS kind, sum(n) AS n, sum(ends) AS ends FROM {{counts}} GROUP BY 1),
        singles AS (
          SELECT uni.w3, (uni.ends - 1 + :weight * cls.ends / cls.n) / (uni.n - 1 + :weight) AS share
          FROM uni JOIN cls ON {_kind('uni.w3')} = cls.kind WHERE uni.ends > 0
        ),
        doubles AS (
          SELECT bi.w2, bi.w3, (bi.ends - 1 + :weight * s.share) / (bi.n - 1 + :weight) AS share
          FROM bi JOIN singles s ON bi.w3 = s.w3 WHERE bi.ends > 0
        ),
        shares AS (
          SELECT tri.w1, tri.w2, tri.w3, (tri.ends - 1 + :weight * d.share) / (tri.n - 1 + :weight) AS terminal
          FROM tri JOIN doubles d ON tri.w2 = d.w2 AND tri.w3 = d.w3 WHERE tri.ends > 0
        )
        SELECT e.doc_id, e.source, s.terminal, s.terminal < :max_terminal AS is_cut
        FROM {{ended}} e JOIN shares s ON e.w1 = s.w1 AND e.w2 = s.w2 AND e.w3 = s.w3
        UNION ALL SELECT doc_id, source, NULL, false FROM {{texts}} WHERE closed OR size(t) = 0
        """,
        args={"weight": weight, "max_terminal": max_terminal, "latin": r"^\p{IsLatin}", "han": r"^\p{IsHan}"},
        texts=texts,
        counts=counts,
        ended=ended,
        known=known,
    )
    return finished(judged, "judged-texts", texts, counts, known)


def truncation_report(docs: DataFrame, value: str = "content") -> DataFrame:
    """``source, n_texts, n_truncated, share`` over all texts that can be cut (NULL source is a source of its own)."""
    return docs.sparkSession.sql(
        "SELECT source, count(*) AS n_texts, count_if(is_cut) AS n_truncated, count_if(is_cut) / count(*) AS share FROM {cut} GROUP BY source",
        cut=truncated(docs, value),
    )

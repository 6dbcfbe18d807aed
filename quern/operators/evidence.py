"""Lexical evidence: the chunks of a candidate document that answer a query best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed_values as V
from quern.functions import text as T
from quern.operators.chunking import let


def overlap_scores(pairs: DataFrame, question: str = "question", body: str = "body", heading: str = "heading", heading_bonus: float = 0.25, exact_bonus: float = 0.0, body_chars: int = 6000) -> DataFrame:
    """Add ``overlap`` to (query, chunk) pairs: shared token occurrences over the
    question's distinct tokens, plus a bonus where the heading holds a token, and
    one where the chunk holds the question's first 80 characters."""
    n = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))

    def score_of(q: Column, c: Column, low: Column) -> Column:
        asked = F.array_distinct(q)
        shared = F.aggregate(asked, F.lit(0), lambda s, t: s + F.least(n(q, t), n(c, t)))
        in_heading = F.exists(q, lambda t: F.contains(low, t))
        return shared / F.greatest(F.size(asked), F.lit(1)) + F.when(in_heading, heading_bonus).otherwise(0.0)

    tokens = F.struct(
        T.evidence_tokens(F.col(question)).alias("q"),
        T.evidence_tokens(T.first_chars(F.col(body), body_chars)).alias("c"),
        T.strip_accents(F.lower(F.col(heading))).alias("low"),
    )
    score = let(tokens, lambda x: score_of(x["q"], x["c"], x["low"]))
    if exact_bonus:
        start = T.first_chars(T.strip_accents(F.lower(F.col(question))), 80)
        score = score + F.when((start != "") & F.contains(T.strip_accents(F.lower(F.col(body))), start), exact_bonus).otherwise(0.0)
    return pairs.withColumn("overlap", score)


def pick(scored: DataFrame, n: int = 3, by: tuple[str, ...] = ("query_id", "doc_id"), words: str = "word_count", chunk: str = "window_idx", target: int = V.WINDOW_WORDS) -> DataFrame:
    """The ``n`` best chunks: by overlap, closeness to ``target`` words, later chunk first."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("overlap", 9)), F.asc(F.abs(F.col(words) - target)), F.desc(chunk))
    return scored.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def evidence_text(picked: DataFrame, by: tuple[str, ...] = ("query_id", "doc_id"), heading: str = "heading", body: str = "body", max_chars: int = 1800) -> DataFrame:
    """One text per (query, document): headings and chunks, best first, cut to ``max_chars``."""
    rows = picked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pick", F.col(heading).alias("h"), F.col(body).alias("b")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: F.concat_ws("\n", F.when(x["h"] != "", x["h"]), x["b"])), "\n\n")
    return rows.select(*by, F.substring(joined, 1, max_chars).alias("evidence"))


def positives(scored: DataFrame, n: int = 2, body: str = "body", **options) -> DataFrame:
    """Training positives: the best ``n`` chunks, blank ones dropped after the cut."""
    return pick(scored, n, **options).filter(F.trim(F.col(body)) != "")

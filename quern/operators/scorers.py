"""Plug points for models: text encoders, pair scorers, word segmenters.

No model is bundled. The defaults are deterministic and lexical, so that every
plan runs end to end; a real model is a function over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as Vec
from quern.operators import fusion

#: batches of (text) -> batches with the vector appended
Encoder = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def hashed_encoder(text: Column, width: int = 64) -> Column:
    """Unit vector of hashed token counts; stands in for a model."""
    slots = F.transform(T.evidence_tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(width)))
    return Vec.unit(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double")))


def encode(df: DataFrame, text: str, encoder: Encoder | None = None, width: int = 64, out: str = "embedding") -> DataFrame:
    """Add vectors: by ``encoder`` over Arrow batches, else by the hashed default."""
    if encoder is None:
        return df.withColumn(out, hashed_encoder(F.col(text), width))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(encoder, f"{schema}, `{out}` array<float>")


def lexical_pair_score(question: Column, evidence: Column) -> Column:
    """Share of the question's tokens that the evidence holds; stands in for a cross-encoder."""
    q, c = F.array_distinct(T.word_tokens(question, deaccent=False)), F.array_distinct(T.word_tokens(evidence, deaccent=False))
    return F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1))


def score_pairs(pairs: DataFrame, scorer: Callable | None = None, question: str = "question", evidence: str = "evidence") -> DataFrame:
    """Add reranker_score by ``scorer`` (question, evidence columns to column), else the lexical default."""
    return pairs.withColumn("reranker_score", (scorer or lexical_pair_score)(F.col(question), F.col(evidence)))


def best_chunk(pairs: DataFrame, by: tuple[str, ...] = ("query_id", "doc_id"), question: str = "question", body: str = "body", chunk: str = "window_idx") -> DataFrame:
    """The chunk with the largest set overlap per document, the first on ties."""
    scored = pairs.withColumn("__s", lexical_pair_score(F.col(question), F.col(body)))
    return scored.groupBy(*by).agg(F.max_by(F.struct(chunk, F.col("__s").alias("overlap")), F.struct(F.round("__s", 9), -F.col(chunk))).alias("best")).select(*by, f"best.{chunk}", "best.overlap")


def segment(df: DataFrame, text: str, segmenter: Callable[[Column], Column] | None = None) -> DataFrame:
    """Collapse white space in ``text``, then apply ``segmenter`` (column to column, such as a
    Pandas UDF around a word segmentation library); without one the text stays so."""
    plain = T.squeeze(F.col(text))
    return df.withColumn(text, segmenter(plain) if segmenter else plain)


def encoder_rerank(pairs: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame] | None = None, depth: int = 100, chunk: str = "window_idx") -> DataFrame:
    """(query_id, doc_id, rank, reranker_score, reranked) from the chunks of ranked documents
    (query_id, doc_id, rank, question, body, chunk): each of the first ``depth`` documents is
    scored by the cosine of question and its lexically best chunk, ties by rank; later ones
    follow as they were. ``embed`` (frame, text column, new column) adds unit vectors; every
    question and every chunk is encoded once."""
    embed = embed or (lambda df, text, out: encode(df, text, out=out))
    head = pairs.filter(F.col("rank") <= depth)
    best = best_chunk(head, chunk=chunk).select("query_id", "doc_id", chunk)
    asked = embed(head.select("query_id", "question").dropDuplicates(["query_id"]), "question", "__q").select("query_id", "__q")
    used = head.join(best, ["query_id", "doc_id", chunk], "left_semi").select("doc_id", chunk, "body").dropDuplicates(["doc_id", chunk])
    vectors = embed(used, "body", "__c").select("doc_id", chunk, "__c")
    scores = best.join(vectors, ["doc_id", chunk]).join(asked, "query_id").select("query_id", "doc_id", Vec.dot(F.col("__q"), F.col("__c")).alias("reranker_score"))
    base = pairs.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return fusion.rerank(base, scores, window=depth)

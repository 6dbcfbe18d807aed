"""Rule queries: each yields (severity, kind, item_id, message); rules are unioned, none is capped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed_values as V
from quern.functions import text as T

#: Severities by kind; an extra answered query may be an error elsewhere.
SEVERITIES = {"extra_query": "warning", "duplicate_question": "warning"}


def issue(rows: DataFrame, kind: str, ident: str, message: Column | str, severities: dict[str, str] | None = None) -> DataFrame:
    severity = (SEVERITIES | (severities or {})).get(kind, "error")
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("item_id"), text.alias("message"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def submission_issues(submission: DataFrame, queries: DataFrame, documents: DataFrame, most: int = V.ANSWER_DOCS, severities: dict[str, str] | None = None) -> DataFrame:
    """``submission``: (query_id, answer array<string>)."""
    rule = lambda rows, kind, message: issue(rows, kind, "query_id", message, severities)
    n = F.coalesce(F.size("answer"), F.lit(0))
    ids = submission.select("query_id", F.explode("answer").alias("doc_id"))
    known = documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return _all([
        rule(queries.join(submission, "query_id", "left_anti"), "missing_query", "no answer given"),
        rule(submission.join(queries, "query_id", "left_anti"), "extra_query", "query is not asked"),
        rule(submission.filter(n == 0), "empty_answer", "answer is empty"),
        rule(submission.filter(n > most), "too_many", F.concat(F.size("answer").cast("string"), F.lit(f" answers, at most {most}"))),
        rule(submission.filter(F.size(F.array_distinct("answer")) < F.size("answer")), "duplicate_answer", "an answer is repeated"),
        rule(ids.join(known, "doc_id", "left_anti"), "unknown_document", F.concat(F.lit("no document "), F.col("doc_id"))),
    ])


def question_issues(queries: DataFrame, documents: DataFrame | None = None, labelled: bool = True, severities: dict[str, str] | None = None) -> DataFrame:
    """``queries``: (query_id, question, answer array<string>)."""
    rule = lambda rows, kind, message: issue(rows, kind, "query_id", message, severities)
    key = T.squeeze(F.col("question"))
    asked = queries.withColumn("__key", key)
    repeated = asked.filter("__key <> ''").groupBy("__key").agg(F.count("*").alias("n"), F.min("query_id").alias("query_id")).filter("n > 1")
    parts = [
        rule(asked.filter("__key is null or __key = ''"), "empty_question", "question is empty"),
        rule(repeated, "duplicate_question", F.concat(F.col("n").cast("string"), F.lit(" queries ask this"))),
    ]
    if labelled:
        parts.append(rule(queries.filter("answer is null or size(answer) = 0"), "empty_answer", "no relevant document"))
        if documents is not None:
            known = documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
            gold = queries.select("query_id", F.explode("answer").alias("doc_id"))
            parts.append(rule(gold.join(known, "doc_id", "left_anti"), "unknown_document", F.concat(F.lit("no document "), F.col("doc_id"))))
    return _all(parts)


def frame_issues(frame: DataFrame, required: list[str], queries: DataFrame, dev: bool = False, folds: int | None = None) -> DataFrame:
    """Of a feature frame: missing columns, query set, folds, and (but for dev) queries without a positive."""
    spark = frame.sparkSession
    lost = [c for c in required if c not in frame.columns]
    parts = [issue(spark.createDataFrame([(c,) for c in lost], "c string"), "missing_column", "c", "column is missing")]
    parts.append(issue(queries.join(frame, "query_id", "left_anti"), "missing_query", "query_id", "query has no row"))
    parts.append(issue(frame.select("query_id").distinct().join(queries, "query_id", "left_anti"), "extra_query", "query_id", "query is not in the split", {"extra_query": "error"}))
    if not dev:
        none = frame.groupBy("query_id").agg(F.sum("label").alias("p")).filter("p = 0")
        parts.append(issue(none, "no_positive", "query_id", "query has no positive row"))
    if folds:
        parts.append(issue(frame.filter(~F.col("fold").between(1, folds) | F.col("fold").isNull()).select("query_id").distinct(), "bad_fold", "query_id", "fold is out of range"))
    return _all(parts)


def coverage(a: DataFrame, b: DataFrame, ident: str = "query_id") -> DataFrame:
    """Ids that only one side has: (ident, side)."""
    x, y = a.select(ident).distinct(), b.select(ident).distinct()
    return x.join(y, ident, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, ident, "left_anti").withColumn("side", F.lit("right")))


def token_id_issues(batches: DataFrame, ids: str, vocabulary: int) -> DataFrame:
    """Rows whose token ids leave 0 to ``vocabulary`` - 1, with ``lowest`` and ``highest``."""
    ranged = batches.withColumns({"lowest": F.array_min(ids), "highest": F.array_max(ids)})
    return ranged.filter((F.col("lowest") < 0) | (F.col("highest") >= vocabulary))


def within_budget(parameters: dict[str, int], allowed: set[str] | None = None, most: int = 4_000_000_000) -> int:
    """Sum of model sizes; fails beyond the budget or for a model that is not allowed."""
    if allowed is not None and (odd := sorted(set(parameters) - allowed)):
        raise ValueError(f"models not allowed: {odd}")
    if (total := sum(parameters.values())) >= most:
        raise ValueError(f"{total} parameters, budget {most}")
    return total

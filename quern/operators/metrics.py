"""Rank metrics, comparisons and audits on (query_id, doc_id, rank) and gold (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed_values as V


def judged(rankings: DataFrame, gold: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, gold_count, ranks): the sorted ranks of relevant documents, a
    document ranked twice by its best, for every query of ``queries`` (crossed with
    ``by`` values of the rankings)."""
    counts = gold.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("gold_count"))
    hits = rankings.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    hits = hits.groupBy(*by, "query_id", "doc_id").agg(F.min("rank").alias("rank"))
    hits = hits.groupBy(*by, "query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    every = queries.select("query_id").distinct()
    if by:
        every = every.crossJoin(F.broadcast(rankings.select(*by).distinct()))
    out = every.join(counts, "query_id", "left").join(hits, [*by, "query_id"], "left")
    return out.select(*by, "query_id", F.coalesce("gold_count", F.lit(0)).alias("gold_count"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))


def _within(k: int) -> Column:
    return F.size(F.filter("ranks", lambda r: r <= k))


def rank_metrics(judgements: DataFrame, depths=V.RECALL_DEPTHS, hits=(1, 5, 20), precisions=(5,), by: tuple[str, ...] = ()) -> DataFrame:
    """Precision (over the full depth), recall, hit and reciprocal rank per query; all 0 without gold."""
    some = F.col("gold_count") > 0
    zero = lambda c: F.when(some, c).otherwise(F.lit(0.0))
    cols = [zero(_within(k) / F.lit(k)).alias(f"precision_{k}") for k in precisions]
    cols += [zero(_within(k) / F.col("gold_count")).alias(f"recall_{k}") for k in depths]
    cols += [zero((_within(k) > 0).cast("double")).alias(f"hit_{k}") for k in hits]
    cols += [zero((_within(90) > 0).cast("double")).alias("exist_90"), zero(F.coalesce(1.0 / F.get("ranks", F.lit(0)), F.lit(0.0))).alias("mrr")]
    return judgements.select(*by, "query_id", "gold_count", *cols)


def official_metrics(rankings: DataFrame, gold: DataFrame, queries: DataFrame, most: int = V.ANSWER_DOCS) -> DataFrame:
    """Precision over the answers given, recall, hit and reciprocal rank; 0 for
    no answer or more than ``most``."""
    given = rankings.groupBy("query_id").agg(F.count("*").alias("n_given"))
    out = judged(rankings, gold, queries).join(given, "query_id", "left").withColumn("n_given", F.coalesce("n_given", F.lit(0)))
    valid = (F.col("n_given") > 0) & (F.col("n_given") <= most) & (F.col("gold_count") > 0)
    n = F.size("ranks")
    score = lambda c: F.when(valid, c).otherwise(F.lit(0.0))
    return out.select(
        "query_id",
        score(n / F.col("n_given")).alias("precision"),
        score(n / F.col("gold_count")).alias("recall"),
        score((n > 0).cast("double")).alias("hit"),
        score(F.coalesce(1.0 / F.get("ranks", F.lit(0)), F.lit(0.0))).alias("mrr"),
    )


def macro(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every metric, over all queries or per group (such as gold_count)."""
    names = [c for c in per_query.columns if c not in ("query_id", "gold_count", *by)]
    aggs = [F.avg(c).alias(c) for c in names]
    aggs.append(F.count("*").alias("n_queries"))
    return per_query.groupBy(*by).agg(*aggs) if by else per_query.agg(*aggs)


def oracle_union(rankings: DataFrame, gold: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """Mean recall of the union of all branches' first ``depth`` rows; queries without gold count as 0."""
    found = rankings.filter(F.col("rank") <= depth).select("query_id", "doc_id").distinct().withColumn("rank", F.lit(1))
    per_query = judged(found, gold, queries)
    recall = F.when(F.col("gold_count") > 0, F.size("ranks") / F.col("gold_count")).otherwise(F.lit(0.0))
    return per_query.agg(F.avg(recall).alias("oracle_recall"), F.count("*").alias("n_queries"))


def compare(before: DataFrame, after: DataFrame, metric: str) -> DataFrame:
    """Per-query change of a metric: (query_id, before, after, delta, outcome)."""
    joined = before.select("query_id", F.col(metric).alias("before")).join(after.select("query_id", F.col(metric).alias("after")), "query_id", "full")
    joined = joined.fillna(0.0, ["before", "after"]).withColumn("delta", F.round(F.col("after") - F.col("before"), 9))
    return joined.withColumn("outcome", F.when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "degraded").otherwise("unchanged"))


def overlap_audit(a: DataFrame, b: DataFrame, k: int = V.ANSWER_DOCS) -> DataFrame:
    """(query_id, overlap, top1_same, changed) of two rankings' first ``k`` rows."""
    lists = []
    for df, name in ((a, "a"), (b, "b")):
        rows = df.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("l"))
        lists.append(rows.select("query_id", F.transform("l", lambda x: x["doc_id"]).alias(name)))
    empty = F.array().cast(a.select(F.array("doc_id")).schema[0].dataType)
    both = lists[0].join(lists[1], "query_id", "full").select("query_id", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    return both.select(
        "query_id",
        F.size(F.array_intersect("a", "b")).alias("overlap"),
        F.coalesce(F.get("a", F.lit(0)) == F.get("b", F.lit(0)), F.lit(False)).alias("top1_same"),
        (F.col("a") != F.col("b")).alias("changed"),
    )


def rank_histogram(final: DataFrame, original: DataFrame, k: int = V.ANSWER_DOCS, buckets: int = 20) -> DataFrame:
    """Where the final top ``k`` stood originally: ranks 1..buckets and one row for the rest (rank null)."""
    top = final.filter(F.col("rank") <= k).select("query_id", "doc_id")
    was = top.join(original.select("query_id", "doc_id", F.col("rank").alias("was")), ["query_id", "doc_id"], "left")
    counts = was.groupBy(F.when(F.col("was") <= buckets, F.col("was")).alias("was")).agg(F.count("*").alias("n"))
    domain = final.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias("bucket")).union(final.sparkSession.range(1).select(F.lit(None).cast("int")))
    return domain.join(counts, domain["bucket"].eqNullSafe(counts["was"]), "left").select(F.col("bucket").alias("original_rank"), F.coalesce("n", F.lit(0)).alias("n"))


def accept(base: dict[str, float], new: dict[str, float], eps: float = 1e-9) -> bool:
    """A better recall at 5, or an equal one with a better precision at 5."""
    if new["recall_5"] > base["recall_5"] + eps:
        return True
    return abs(new["recall_5"] - base["recall_5"]) <= eps and new["precision_5"] > base["precision_5"] + eps


def best_trials(summary: DataFrame, keys=("recall_5", "precision_5", "recall_20", "mrr"), trial: str = "trial") -> DataFrame:
    """Trials by the metrics in turn, the earlier one on ties."""
    return summary.orderBy(*[F.desc(F.round(k, 9)) for k in keys], F.asc(trial))

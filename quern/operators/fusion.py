"""Rank and score fusion on long rankings (query_id, doc_id, branch, rank[, score])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed_values as V

TIES = ("first_seen", "rank_first", "doc_id")


def rrf(rankings: DataFrame, weights: DataFrame, k: int = V.RRF_K, tie: str = "first_seen", top: int | None = V.TOP_DOCS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal-rank fusion. ``weights`` (branch, weight[, depth, branch_order][, by...])
    drops branches of weight 0 or less and ranks past ``depth``. One shuffle on (by, doc_id)
    after partial sums, one on ``by`` for the rank."""
    joined = rankings.join(F.broadcast(weights), "branch")
    joined = joined.filter("weight > 0")
    if "depth" in weights.columns:
        joined = joined.filter((F.col("depth") <= 0) | (F.col("rank") <= F.col("depth")))
    order = F.col("branch_order") if "branch_order" in weights.columns else F.col("branch")
    fused = joined.groupBy(*by, "doc_id").agg(
        F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min(F.struct(order.alias("o"), F.col("rank").alias("r"))).alias("__seen"),
        F.min(F.struct(F.col("rank").alias("r"), order.alias("o"))).alias("__rank"),
    )
    return ranked(fused, by, _ties(tie), top).drop("__seen", "__rank")


def rrf_configs(rankings: DataFrame, configs: DataFrame, top: int = V.ANSWER_DOCS) -> DataFrame:
    """Named configurations (config, k, branch, weight, depth, branch_order) in one job:
    (config, query_id, doc_id, score, rank). A depth of 0 takes the whole branch. A document
    counts by its best rank in a branch. The configurations are few: each sorts a query's
    list of documents, so rows are never multiplied by them."""
    given: dict[str, list] = {}
    for r in configs.collect():
        if r["weight"] > 0:
            given.setdefault(r["config"], []).append(r)
    used = sorted({r["branch"] for rows in given.values() for r in rows})
    if not used:
        return rankings.select(F.lit("").alias("config"), "query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    place = {b: f"r{i}" for i, b in enumerate(used)}
    wide = rankings.groupBy("query_id", "doc_id").agg(*[F.min(F.when(F.col("branch") == b, F.col("rank"))).alias(c) for b, c in place.items()])
    lists = wide.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", *place.values())).alias("l"))

    def best(rows: list) -> Column:
        rank = lambda x, r: F.when(F.lit(r["depth"] <= 0) | (x[place[r["branch"]]] <= r["depth"]), x[place[r["branch"]]])

        def entry(x: Column) -> Column:
            score = sum((F.coalesce(F.lit(float(r["weight"])) / (F.lit(float(r["k"])) + rank(x, r)), F.lit(0.0)) for r in rows), F.lit(0.0))
            first = [F.when(rank(x, r).isNotNull(), F.struct(rank(x, r).alias("r"), F.lit(r["branch_order"]).alias("o"))) for r in rows]
            return F.struct((-F.round(score, 9)).alias("s"), (F.least(*first) if len(first) > 1 else first[0]).alias("f"), x["doc_id"].alias("doc_id"), score.alias("score"))

        found = F.filter(F.transform("l", entry), lambda e: e["f"].isNotNull())
        return F.transform(F.slice(F.sort_array(found), 1, top), lambda e: F.struct(e["doc_id"].alias("doc_id"), e["score"].alias("score")))

    each = F.array(*[F.struct(F.lit(name).alias("config"), best(rows).alias("l")) for name, rows in given.items()])
    rows = lists.select("query_id", F.explode(each).alias("x")).select("x.config", "query_id", F.posexplode("x.l").alias("at", "e"))
    return rows.select("config", "query_id", "e.doc_id", "e.score", (F.col("at") + 1).alias("rank"))


def _ties(tie: str) -> list[Column]:
    if tie not in TIES:
        raise ValueError(f"tie is one of {TIES}")
    return {"first_seen": [F.asc("__seen")], "rank_first": [F.asc("__rank")], "doc_id": []}[tie] + [F.asc("doc_id")]


def ranked(scored: DataFrame, by: tuple[str, ...], ties: list[Column], top: int | None, score: str = "score") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), *ties)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def min_max(value: Column, over) -> Column:
    """Scaled to 0..1 in the window; 0.5 for all where the range is under 1e-12."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((value - lo) / (hi - lo))


def score_fusion(base: DataFrame, signals: list[str], weights: list[Column | float], rank_weight: Column | float, window: int = V.RERANK_DOCS, top: int = V.TOP_DOCS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Fuse a base ranking (rank) with score columns inside its first ``window`` rows:
    the weighted sum of min-max scaled reciprocal rank and scores, a missing score
    counting 0. Later rows keep their order behind. Ties go by base rank."""
    over = Window.partitionBy(*by)
    head = F.col("rank") <= window
    total = F.lit(0.0) + rank_weight * min_max(F.when(head, 1.0 / F.col("rank")), over)
    for name, weight in zip(signals, weights):
        total = total + weight * F.coalesce(min_max(F.when(head, F.col(name)), over), F.lit(0.0))
    both = base.filter(F.col("rank").isNotNull()).withColumn("fused_score", F.when(head, total).otherwise(-F.col("rank") * 1e-6))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("fused_score", 9)), F.asc("rank"))
    return both.withColumn("fused_rank", F.row_number().over(w)).filter(F.col("fused_rank") <= top)


def rerank(base: DataFrame, scores: DataFrame, window: int = V.RERANK_DOCS) -> DataFrame:
    """The first ``window`` rows by score (ties by rank; unscored ones after), then the tail as it was."""
    joined = base.join(scores, ["query_id", "doc_id"], "left")
    inside = (F.col("rank") <= window) & F.col("reranker_score").isNotNull()
    w = Window.partitionBy("query_id").orderBy(inside.desc(), F.when(inside, F.round("reranker_score", 9)).desc_nulls_last(), F.asc("rank"))
    return joined.withColumn("reranked", F.row_number().over(w))


def score_fusion_grid(base: DataFrame, signals: list[str], trials: list[tuple[float, ...]], window: int = V.RERANK_DOCS, top: int = V.TOP_DOCS) -> DataFrame:
    """``score_fusion`` for every trial (rank weight, then a weight per signal): rows
    (trial, ..., fused_score, fused_rank), trials numbered from 0. The signals are scaled
    once; every trial sorts a query's list, so rows are multiplied by the trials only in the
    result. The list has the rows in ``window`` and the first ``top`` of those behind, whose
    order among themselves is the base rank in every trial: no other row is in a result.
    Without negative weights these follow all rows in ``window`` and are ordered once."""
    head = F.col("rank") <= window
    place = F.row_number().over(Window.partitionBy("query_id", F.col("rank") > window).orderBy("rank"))
    kept = base.filter(F.col("rank").isNotNull()).withColumn("__place", place).filter(head | (F.col("__place") <= top)).drop("__place")
    cols = [c for c in base.columns if c != "query_id"]
    values = [1.0 / F.col("rank"), *[F.col(c) for c in signals]]
    ends = [f(F.when(head, v)).alias(f"__{f.__name__}{i}") for i, v in enumerate(values) for f in (F.min, F.max)]
    row = F.struct(*cols).alias("row"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)]
    lists = kept.groupBy("query_id").agg(F.collect_list(F.struct(*row)).alias("__l"), *ends)

    def scaled(x: Column) -> Column:
        parts = []
        for i in range(len(values)):
            lo, hi = F.col(f"__min{i}"), F.col(f"__max{i}")
            part = F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((x[f"v{i}"] - lo) / (hi - lo))
            parts.append(F.coalesce(part, F.lit(0.0)).alias(f"p{i}"))
        return F.struct(x["row"].alias("row"), (x["row"]["rank"] <= window).alias("head"), *parts)

    table = F.array(*[F.struct(F.lit(n).alias("trial"), *[F.lit(float(w)).alias(f"w{i}") for i, w in enumerate(t)]) for n, t in enumerate(trials)])
    lists = lists.select("query_id", F.transform("__l", scaled).alias("__l"))

    def rows_of(entries: str, order: Column) -> Column:
        return F.transform(order, lambda e: F.struct(F.get(F.col(entries), e["i"])["row"].alias("row"), e["s"].alias("s")))

    apart = window >= 0 and all(w >= 0 for t in trials for w in t)
    if apart:
        lists = lists.select("query_id", F.filter("__l", lambda x: x["head"]).alias("__l"), F.filter("__l", lambda x: ~x["head"]).alias("__rest"))
        behind = F.transform("__rest", lambda x, i: F.struct(x["row"]["rank"].alias("r"), i.alias("i"), (-x["row"]["rank"] * 1e-6).alias("s")))
        lists = lists.withColumn("__rest", rows_of("__rest", F.sort_array(behind)))
    crossed = lists.select("*", F.explode(table).alias("__t"))

    def scored(x: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for n in range(len(values)):
            total = total + F.col(f"__t.w{n}") * x[f"p{n}"]
        rank = x["row"]["rank"]
        return F.struct(F.when(x["head"], total).otherwise(-rank * 1e-6).alias("s"), x["head"].alias("head"), (-rank).alias("r"), i.alias("i"))

    # A millionth of the rank, rounded to nine decimals, is the quotient itself.
    key = lambda e: F.struct(F.when(e["head"], F.round(e["s"], 9)).otherwise(e["r"] / F.lit(1e6)).alias("k"), e["r"].alias("r"), e["i"].alias("i"), e["s"].alias("s"))
    best = rows_of("__l", F.sort_array(F.transform(F.transform("__l", scored), key), asc=False))
    best = F.slice(F.concat(best, "__rest") if apart else best, 1, top)
    rows = crossed.select("query_id", F.col("__t.trial").alias("trial"), F.posexplode(best).alias("__at", "__e"))
    given = [F.col("query_id") if c == "query_id" else F.col(f"__e.row.{c}").alias(c) for c in base.columns]
    return rows.select(*given, "trial", F.col("__e.s").alias("fused_score"), (F.col("__at") + 1).alias("fused_rank"))

"""Splits, folds, negatives and feature frames; every random order is a hash of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed_values as V


def hash_order(seed: str, *cols: str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def hash_place(df: DataFrame, ident: str, stratum: str, seed: str, out: str = "__n") -> DataFrame:
    """Add a row's place (from 1) in its stratum's hash order. Rows are ranked within 4,096
    ranges of the hash and the ranges' counts added, so no task sorts a whole stratum."""
    keyed = df.withColumn("__h", hash_order(seed, ident)).withColumn("__p", F.substring("__h", 1, 3))
    sizes = keyed.groupBy(F.col(stratum).alias("__s2"), F.col("__p").alias("__p2")).agg(F.count("*").alias("__size"))
    before = Window.partitionBy("__s2").orderBy("__p2").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__s2", "__p2", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(stratum, "__p").orderBy("__h", ident))
    placed = keyed.withColumn(out, local).join(starts, F.col(stratum).eqNullSafe(F.col("__s2")) & (F.col("__p") == F.col("__p2")))
    return placed.withColumn(out, F.col(out) + F.col("__start")).drop("__h", "__p", "__s2", "__p2", "__start")


def stratified_split(df: DataFrame, ident: str, stratum: str, size: int, seed: str = "split") -> DataFrame:
    """Add ``part`` (dev or train): ``size`` dev rows shared out over the strata by floor, then by
    largest remainder, larger stratum values first on ties. A stratum's rows go by hash."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = df.sparkSession.range(1).crossJoin(counts.agg(F.sum("n").alias("total"))).select("total")
    quota = counts.crossJoin(F.broadcast(total)).withColumn("exact", F.lit(size) * F.col("n") / F.col("total"))
    quota = quota.withColumns({"base": F.floor("exact"), "left": F.round(F.col("exact") - F.floor("exact"), 9)})
    # One row per stratum: a small window over the whole of them.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("left"), F.desc(stratum))
    spare = F.lit(size) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    quota = quota.withColumn("take", F.col("base") + (F.row_number().over(order) <= spare).cast("int"))
    placed = hash_place(df, ident, stratum, seed).join(F.broadcast(quota.select(F.col(stratum).alias("__s"), "take")), F.col(stratum).eqNullSafe(F.col("__s")))
    return placed.withColumn("part", F.when(F.col("__n") <= F.col("take"), "dev").otherwise("train")).drop("__n", "__s", "take")


def folds(df: DataFrame, ident: str, stratum: str, k: int = 5, seed: str = "folds") -> DataFrame:
    """Add ``fold`` 1..k, dealt round within each stratum in hash order."""
    return hash_place(df, ident, stratum, seed).withColumn("fold", ((F.col("__n") - 1) % k + 1).cast("int")).drop("__n")


def phases(assigned: DataFrame, ident: str, k: int = 5) -> DataFrame:
    """(ident, phase, role): in phase oof_fold_i, fold i is held out and the rest is the base."""
    each = F.explode(F.sequence(F.lit(1), F.lit(k)))
    rows = assigned.select(ident, "fold", each.alias("__k"))
    role = F.when(F.col("fold") == F.col("__k"), "heldout").otherwise("base")
    return rows.select(ident, F.concat(F.lit("oof_fold_"), F.col("__k").cast("string")).alias("phase"), role.alias("role"))


def audit_folds(assigned: DataFrame, ident: str, k: int = 5) -> DataFrame:
    """Ids that are not in exactly one fold of 1..k: (ident, n)."""
    counts = assigned.groupBy(ident).agg(F.sum(F.col("fold").between(1, k).cast("int")).alias("n"))
    return counts.filter("n <> 1")


def semi_hard_negatives(candidates: DataFrame, gold: DataFrame, pool: int = 80, first: int = 6, last: int = 60, per_gold: int = 10, most: int | None = None, seed: str = "negatives") -> DataFrame:
    """(query_id, gold_doc, doc_id): per relevant document, up to ``per_gold`` of the query's
    candidates that are not relevant and stand at ``first``..``last`` among those;
    with ``most``, a random choice of that many in all."""
    rest = candidates.filter(F.col("rank") <= pool).join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    band = rest.withColumn("place", F.row_number().over(w)).filter(F.col("place").between(first, last))
    # A query's band is a list of ``pool`` ids at most: each relevant document sorts it in its own
    # hash order, so the pairs are neither shuffled nor sorted on disk.
    lists = band.groupBy("query_id").agg(F.collect_list("doc_id").alias("__band"))
    pairs = gold.select("query_id", F.col("doc_id").alias("gold_doc")).distinct().join(lists, "query_id")
    start = F.concat_ws("|", F.lit(seed), F.col("query_id").cast("string"), F.col("gold_doc").cast("string"))
    keyed = F.transform("__band", lambda d: F.struct(F.sha1(F.concat_ws("|", start, d.cast("string")).cast("binary")).alias("h"), d.alias("doc_id")))
    chosen = pairs.select("query_id", "gold_doc", F.explode(F.slice(F.sort_array(keyed), 1, per_gold)).alias("x")).select("query_id", "gold_doc", "x.doc_id")
    return chosen if most is None else chosen.orderBy(hash_order(seed, "query_id", "gold_doc", "doc_id")).limit(most)


def band(ranked: DataFrame, first: int = 4, last: int = 40) -> DataFrame:
    """Ranks ``first``..``last``; for queries without any there, all up to ``last``."""
    inside = ranked.withColumn("__any", F.max((F.col("rank").between(first, last)).cast("int")).over(Window.partitionBy("query_id")))
    keep = F.col("rank").between(first, last) | ((F.col("__any") == 0) & (F.col("rank") <= last))
    return inside.filter(keep).drop("__any")


def feature_frame(branches: dict[str, DataFrame] | DataFrame, gold: DataFrame, cap: int = 200, inject_gold: bool = True, k: int = V.RRF_K, names: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, label, rank and reciprocal rank and score per branch, agreement at 5 and 20).

    Candidates are the equal-weight fusion of the branches, at most ``cap`` per query;
    with ``inject_gold`` relevant documents that are missing replace the tail. The branches
    are given one by one, or as long rows (..., branch) with their ``names``. One grouped pass
    aligns them; fusion, labels and the cut follow on the same rows, by query."""
    if isinstance(branches, DataFrame):
        stacked = branches.select("query_id", "doc_id", "branch", "rank", "score").filter(F.col("branch").isin(*names))
    else:
        names, stacked = tuple(branches), None
        for name, df in branches.items():
            one = df.select("query_id", "doc_id", F.lit(name).alias("branch"), "rank", "score")
            stacked = one if stacked is None else stacked.unionByName(one)
    of = lambda n, c: F.when(F.col("branch") == n, F.col(c))
    per_branch = [e for n in names for e in (F.min(of(n, "rank")).alias(f"{n}_rank"), F.max(of(n, "score")).alias(f"{n}_score"))]
    score = F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("__fused")
    wide = stacked.groupBy("query_id", "doc_id").agg(*per_branch, score)
    labels = gold.select("query_id", "doc_id").distinct().withColumn("label", F.lit(1))
    both = wide.join(labels, ["query_id", "doc_id"], "full" if inject_gold else "left")
    own = Window.partitionBy("query_id")
    place = F.row_number().over(own.orderBy(F.desc_nulls_last(F.round("__fused", 9)), F.asc("doc_id")))
    both = both.withColumn("__rank", F.when(F.col("__fused").isNotNull(), place))
    if inject_gold:
        lost = F.col("label").isNotNull() & (F.col("__rank").isNull() | (F.col("__rank") > cap))
        both = both.withColumn("__lost", lost).withColumns({"__room": F.lit(cap) - F.sum(F.col("__lost").cast("int")).over(own), "__known": F.max("__rank").over(own)})
        both = both.filter((F.col("__rank") <= F.col("__room")) | (F.col("__lost") & F.col("__known").isNotNull()))
    else:
        both = both.filter(F.col("__rank") <= cap)
    rank = lambda n: F.coalesce(F.col(f"{n}_rank"), F.lit(V.MISSING_RANK))
    agreement = lambda d: sum(((rank(n) <= d).cast("int") for n in names), F.lit(0))
    cols = ["query_id", "doc_id", F.coalesce("label", F.lit(0)).alias("label")]
    for n in names:
        cols += [rank(n).alias(f"{n}_rank"), F.coalesce(1.0 / F.col(f"{n}_rank"), F.lit(0.0)).alias(f"{n}_rr"), F.coalesce(f"{n}_score", F.lit(0.0)).alias(f"{n}_score")]
    return both.select(*cols, agreement(5).alias("agreement_top5"), agreement(20).alias("agreement_top20"))


def missing_positives(frame: DataFrame) -> DataFrame:
    """Queries of a training frame without a positive row."""
    return frame.groupBy("query_id").agg(F.sum("label").alias("positives")).filter("positives = 0").select("query_id")

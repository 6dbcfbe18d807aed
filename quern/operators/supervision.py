"""Training pairs, supervision skeletons, phases and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed_values as V
from quern.functions import text as T
from quern.operators import evidence, sampling, validate

PAIR = ["query_id", "doc_id"]


def training_pairs(scored: DataFrame, gold: DataFrame, positives: int = 2, most: int | None = None, seed: str = "pairs", chunk: str = "window_idx") -> DataFrame:
    """Rows of ``scored`` (chunks with ``overlap``): per relevant document its ``positives``
    best chunks, blank ones dropped after the cut; with ``most``, that many in hash order."""
    own = scored.join(gold.select(*PAIR).distinct(), PAIR, "left_semi")
    chosen = evidence.positives(own, positives, chunk=chunk)
    return chosen if most is None else chosen.orderBy(sampling.hash_order(seed, *PAIR, chunk)).limit(most)


def skeleton(scored: DataFrame, gold: DataFrame, rankings: DataFrame, positives: int = 5, candidates: int = 80, words: str = "word_count", chunk: str = "window_idx", body: str = "body", target: int = V.WINDOW_WORDS) -> DataFrame:
    """(query_id, doc_id, kind, place, chunk): the best ``positives`` chunks of relevant
    documents, and the best chunk of every other document ranked within ``candidates``.
    Blank chunks are dropped before the cut; ties go by closeness to ``target`` words,
    then to the earlier chunk."""
    order = Window.partitionBy(*PAIR).orderBy(F.desc(F.round("overlap", 9)), F.asc(F.abs(F.col(words) - target)), F.asc(chunk))
    best = scored.filter(F.trim(F.col(body)) != "").select(*PAIR, chunk, F.row_number().over(order).alias("place")).filter(F.col("place") <= positives)
    relevant = gold.select(*PAIR).distinct().withColumn("__gold", F.lit(True))
    near = rankings.filter(F.col("rank") <= candidates).select(*PAIR).distinct().withColumn("__near", F.lit(True))
    rows = best.join(relevant, PAIR, "left").join(near, PAIR, "left")
    rows = rows.filter(F.col("__gold") | (F.col("__near") & (F.col("place") == 1)))
    kind = F.when(F.col("__gold"), "positive").otherwise("negative")
    return rows.select(*PAIR, kind.alias("kind"), "place", chunk)


def without_positives(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Relevant documents that gave no positive chunk."""
    return gold.select(*PAIR).distinct().join(found.filter("kind = 'positive'").select(*PAIR), PAIR, "left_anti")


def fast_holdout(gold: DataFrame, size: int = 1000, most: int = 4, seed: str = "holdout") -> DataFrame:
    """(query_id, stratum, part): ``size`` queries held out (dev), stratified by the number of
    relevant documents, ``most`` and more as one stratum."""
    counts = gold.select(*PAIR).distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("stratum"))
    return sampling.stratified_split(counts, "query_id", "stratum", size, seed)


def phase_table(train: DataFrame, dev: DataFrame, holdout: DataFrame, folds: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, phase, role) of every phase: fast, oof_fold_1 to ``k`` and fulltrain_dev;
    base queries are trained on, heldout ones get features."""
    fast = holdout.select("query_id", F.lit("fast").alias("phase"), F.when(F.col("part") == "dev", "heldout").otherwise("base").alias("role"))
    full = train.select("query_id", F.lit("fulltrain_dev").alias("phase"), F.lit("base").alias("role"))
    target = dev.select("query_id", F.lit("fulltrain_dev").alias("phase"), F.lit("heldout").alias("role"))
    return reduce(DataFrame.unionByName, [fast, sampling.phases(folds, "query_id", k), full, target])


def phase_leaks(table: DataFrame) -> DataFrame:
    """(phase, query_id) of queries that a phase both trains on and holds out."""
    return table.groupBy("phase", "query_id").agg(F.countDistinct("role").alias("n")).filter("n > 1").select("phase", "query_id")


def dry_run(table: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` queries of every phase and role, ids of digits first by value."""
    w = Window.partitionBy("phase", "role").orderBy(*T.numeric_first("query_id"))
    return table.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def merge_issues(parts: dict[str, tuple[DataFrame, DataFrame]], required: list[str], k: int = 5) -> DataFrame:
    """(part, severity, kind, item_id, message) of feature frames about to be merged, given as
    part: (frame, expected queries). The part oof must hold folds 1 to ``k``, fulltrain_dev
    fold -1 only; the latter may lack positives."""
    found = []
    for name, (frame, expected) in parts.items():
        dev = name == "fulltrain_dev"
        rows = validate.frame_issues(frame, required, expected, dev=dev, folds=k if name == "oof" else None)
        if dev:
            odd = frame.filter("fold is null or fold <> -1").select("query_id").distinct()
            rows = rows.unionByName(validate.issue(odd, "bad_fold", "query_id", "fold is not -1"))
        if name == "oof":
            every = frame.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("fold"))
            lost = every.join(frame.select("fold").distinct(), "fold", "left_anti")
            rows = rows.unionByName(validate.issue(lost, "missing_fold", "fold", "fold has no row"))
        found.append(rows.select(F.lit(name).alias("part"), "*"))
    return reduce(DataFrame.unionByName, found)


def sorted_frame(frame: DataFrame, ranks: list[str]) -> DataFrame:
    """A feature frame in its file order: query (ids of digits first, by value), then the
    branches' ranks, then document. The sort is by ranges, not in one task."""
    return frame.orderBy(*T.numeric_first("query_id"), *[F.asc(c) for c in ranks], F.asc("doc_id"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in file order, for trial runs."""
    return df.orderBy(*order).limit(n)


def positions(needed: DataFrame, key: str, width: int = 1 << 20) -> DataFrame:
    """(key, position): distinct integer keys numbered from 0 in ascending order, such as the
    rows of an embedding file for the chunks in use. Keys are ranked within ranges of
    ``width`` values, so no task holds more than that many; only range counts are summed."""
    rows = needed.select(key).distinct().withColumn("__p", (F.col(key) - F.pmod(F.col(key), F.lit(width))).cast("bigint"))
    before = Window.partitionBy(F.lit(1)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return rows.withColumn("__k", place).join(starts, "__p").select(key, (F.col("__start") + F.col("__k")).alias("position"))

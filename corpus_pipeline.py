"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise, table
from quern.llm.decontam import find_leaks
from quern.llm.jaccard_join import jaccard_classes, with_class_keys
from quern.llm.packing import pack_documents
from quern.llm.secret_scan import redact_secrets
from quern.llm.toxicity import fit_from, score_toxicity, training_labels

TOKENIZER = "word_bpe_49k.json"
BROADCAST_ROWS = 500_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the lexicon model, fitted on the training fold's labels, predicts toxic."""
    model = fit_from(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a 5-word shingle Jaccard similarity of 0.75 or
    more, one row stays: that of the smallest id (ids before null), then of the smallest
    text, then any of the equal ones. Rows are told apart by more than their id, so a
    row whose id is also in another group is kept or dropped with its own group.
    Rows without words are in no group and stay."""
    members, classes = jaccard_classes(docs)
    rows = members.join(classes, "key").select("doc_id", F.coalesce("label", "key").alias("__label"), F.col("component_id").alias("__least"))
    # Only groups of several rows; __firsts counts the rows that have the smallest id.
    groups = rows.groupBy("__label", "__least").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").eqNullSafe(F.col("__least"))).alias("__firsts")).filter("n > 1").drop("n")
    groups = materialise(classes.select(F.col("key").alias("__of"), F.coalesce("label", "key").alias("__label")).join(groups, "__label"))
    several = not groups.filter("__firsts > 1").isEmpty()
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    keyed = with_class_keys(docs, "__key")
    placed = keyed.join(groups, keyed["__key"] == groups["__of"], "left")
    first = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__least"))
    kept = placed.filter(F.col("__of").isNull() | (first & (F.col("__firsts") == 1))).select(*docs.columns)
    if not several:
        return kept
    # Few rows: repeated ids, or groups without any id.
    tied = materialise(placed.filter(first & (F.col("__firsts") > 1)).withColumn("__row", F.monotonically_increasing_id()).select(*docs.columns, "__label", "__row"))
    best = tied.groupBy("__label").agg(F.min(F.struct("text", "__row")).alias("__best"))
    return kept.union(tied.join(best, "__label").filter(F.col("__row") == F.col("__best.__row")).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, verbatim or edited."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows where a text changes."""
    clean = redact_secrets(docs.withColumn("__before", F.length("text")))
    changed = F.col("__before") != F.length("text")
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("packing", packing),
]

#: SQL has no tokenizer, alignment or lexicon model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs

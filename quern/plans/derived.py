"""Inputs of the catalogue, derived from the standard tables, in Spark and as SQL fragments.

* Corpus: ``documents`` cut into windows, heading = source; questions: ``benchmark``.
* Rankings: each customer's parts by quantity (a), by revenue (b), by count (c);
  relevant parts are those the customer returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import chunking

BRANCHES = ("a", "b", "c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, window_idx, start_word, end_word, body, heading, text)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = chunking.windows(docs, "text")
    return cut.select("doc_id", "window_idx", "start_word", "end_word", "body", F.col("source").alias("heading"), F.concat_ws("\n", "source", "body").alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, a, b, c): a customer's quantity, revenue and count per part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    # Dealt by customer once: all that is grouped, ranked or joined by query follows without another shuffle.
    rows = joined.select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), "l_quantity", revenue.alias("revenue")).repartition("query_id")
    return rows.groupBy("query_id", "doc_id").agg(
        F.round(F.sum("l_quantity"), 4).alias("a"),
        F.round(F.sum("revenue"), 4).alias("b"),
        F.count("*").cast("double").alias("c"),
    )


def ranked_purchases(spark: SparkSession, sf_dir: str, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """(query_id, doc_id, a, b, c, <branch>_rank...): ``purchases`` with the ranks beside each other."""
    rows = purchases(spark, sf_dir)
    for b in branches:
        rows = rows.withColumn(f"{b}_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(b), F.asc("doc_id"))))
    return rows


def rankings(spark: SparkSession, sf_dir: str, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """(query_id, doc_id, branch, score, rank)"""
    each = [F.struct(F.lit(b).alias("branch"), F.col(b).alias("score"), F.col(f"{b}_rank").alias("rank")) for b in branches]
    stacked = ranked_purchases(spark, sf_dir, branches).select("query_id", "doc_id", F.explode(F.array(*each)).alias("x"))
    return stacked.select("query_id", "doc_id", "x.branch", "x.score", "x.rank")


def branch(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rankings(spark, sf_dir, (name,)).drop("branch")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): parts a customer returned."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).repartition("query_id").distinct()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))


SQL_PURCHASES = """purchases AS (
  SELECT o_custkey AS query_id, l_partkey AS doc_id, round(sum(l_quantity), 4) AS a,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS b, CAST(count(*) AS DOUBLE) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
)"""
SQL_RANKINGS = (
    SQL_PURCHASES
    + """, rankings AS (
  SELECT query_id, doc_id, branch, score, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, 'a' AS branch, a AS score FROM purchases
        UNION ALL SELECT query_id, doc_id, 'b', b FROM purchases
        UNION ALL SELECT query_id, doc_id, 'c', c FROM purchases)
)"""
)
SQL_GOLD = """gold AS (
  SELECT DISTINCT o_custkey AS query_id, l_partkey AS doc_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
)"""
SQL_WINDOWS = r"""doc_words AS (
  SELECT doc_id, source, regexp_extract_all(text, '\S+') AS w FROM documents
), windows AS (
  SELECT doc_id, source AS heading, k AS window_idx, k * 260 AS start_word, least(k * 260 + 320, len(w)) AS end_word,
    array_to_string(w[k * 260 + 1:least(k * 260 + 320, len(w))], ' ') AS body
  FROM (SELECT doc_id, source, w, unnest(range(0, 1 + greatest(CAST(ceil((len(w) - 320) / 260.0) AS INT), 0))) AS k FROM doc_words WHERE len(w) > 0)
)"""

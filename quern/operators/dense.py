"""Exact vector search and pools.

The query side is cut into blocks of bounded size; each block is broadcast and
multiplied with the corpus in runs of bounded size (Arrow, numpy), of which a task
keeps the best ``k`` rows per query as it goes. So what is shuffled is queries * k rows
per task, and a large query set is more blocks, not a larger broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as Vec

BLOCK_QUERIES = 4096
#: (query, row) cells that a task scores at once.
RUN_CELLS = 1 << 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width) if len(flat) else np.zeros((0, width))


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", corpus_id: str = "chunk_idx", vector: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, corpus_id, score, rank): the ``k`` largest dot products per query,
    ties by id. Ids are integers; vectors of one width, null ones are left out."""
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).alias("v"))
    n = asked.count()
    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(corpus_id).cast("bigint").alias("c"), F.col(vector).alias("v"))
    blocks = max(1, -(-n // block))
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        if not part:
            continue
        ids, vectors = np.array([r["q"] for r in part]), np.array([r["v"] for r in part], float)
        sent = corpus.sparkSession.sparkContext.broadcast((ids, vectors))
        some = rows.mapInArrow(_search(sent, k), "q long, c long, score double")
        found = some if found is None else found.unionAll(some)
    if found is None:
        found = rows.select(F.col("c").alias("q"), "c", F.lit(0.0).alias("score")).limit(0)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), F.asc("c"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("c").alias(corpus_id), "score", "rank")


def _search(sent, k: int):
    def run(batches):
        ids, vectors = sent.value
        step = max(1, RUN_CELLS // len(ids))
        best, owner = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                c = part.column(0).to_numpy()
                scores = np.concatenate([best, vectors @ _matrix(part.column(1), vectors.shape[1]).T], axis=1)
                rows = np.concatenate([owner, np.broadcast_to(c, (len(ids), len(c)))], axis=1)
                order = np.lexsort((rows, -np.round(scores, 9)), axis=1)[:, :k]
                best, owner = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(owner.ravel()), pa.array(best.ravel())], names=["q", "c", "score"])

    return run


def pair_scores(pairs: DataFrame, left: str = "query_vector", right: str = "chunk_vector") -> DataFrame:
    """Cosine of unit vectors for given pairs (re-ranking)."""
    return pairs.withColumn("score", Vec.dot(F.col(left), F.col(right)))


def semantic_pool(pairs: DataFrame, size: int = 40, query: str = "query_id", ties: str = "chunk_idx") -> DataFrame:
    """The ``size`` best candidates per query by cosine."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), F.asc(ties))
    return pairs.withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= size)

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but space, tab, LF, VT, FF, CR.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can reach.

    Where the session names none, a local folder is made, if all tasks run on this machine.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (context.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.environ.get("QUERN_LOCAL_CHECKPOINTS") or tempfile.mkdtemp(prefix="quern-")
        os.environ["QUERN_LOCAL_CHECKPOINTS"] = base
        base = f"file://{base}"
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs only the task it was running. The folder goes when the
    session's driver ends (see ``drop_at_exit``)."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(drop_at_exit(spark, path))


def materialise_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialise``, and the number of rows, counted while they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def drop_at_exit(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when the driver's JVM ends: results are read lazily,
    so nothing written for one may go before."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def input_bytes(df: DataFrame) -> int:
    """Optimizer's size of the scan below ``df`` (file sizes; no job is run)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 1 << 30


def buckets_for(total_bytes: float, per_bucket: float, least: int = 1) -> int:
    return max(least, math.ceil(total_bytes / per_bucket))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column that a lambda refers to
    may be inlined there by the optimizer and computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_within(sizes: list[tuple[int, int]], most: int) -> int | None:
    """The last key of ascending (key, bytes) up to which the bytes together are within ``most``."""
    last = None
    for key, n in sizes:
        most -= n
        if most < 0:
            break
        last = key
    return last

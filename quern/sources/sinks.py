"""Writers: distributed for tables, on the driver for small reports and submissions."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed_values as V

ZIP_DATE = (2026, 8, 18, 0, 0, 0)


def write_json(path: str, payload, sort_keys: bool = False) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=sort_keys) + "\n", encoding="utf-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrites."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def wide_rankings(rows: DataFrame, extra: tuple[str, ...] = ("score",)) -> DataFrame:
    """(query_id, doc_ids, top_docs) of long rows (query_id, doc_id, rank, ...)."""
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", *extra))).alias("top_docs"))
    return packed.select("query_id", F.transform("top_docs", lambda x: x["doc_id"]).alias("doc_ids"), "top_docs")


def make_submission(rows: DataFrame, most: int = V.ANSWER_DOCS) -> DataFrame:
    """(query_id, answer): the first ``most`` ids as text."""
    lists = wide_rankings(rows, ())
    return lists.select(F.col("query_id").cast("string").alias("query_id"), F.transform(F.slice("doc_ids", 1, most), lambda x: x.cast("string")).alias("answer"))


def submission_payload(submission: DataFrame) -> dict:
    """A submission holds a few ids per query and goes to one file, so the driver gathers it."""
    return {r["query_id"]: {"answer": list(r["answer"])} for r in submission.orderBy("query_id").toLocalIterator()}


def write_zip(path: str, members: dict[str, bytes]) -> str:
    """A zip that depends on its members alone; checked after writing. Returns its SHA-256."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name.replace("\\", "/"), ZIP_DATE)
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(info, members[name])
    with zipfile.ZipFile(path) as z:
        if z.namelist() != sorted(members):
            raise ValueError(f"{path} holds {z.namelist()}")
    return file_sha256(path)


def write_submission_zip(path: str, submission: DataFrame) -> str:
    body = json.dumps(submission_payload(submission), ensure_ascii=False, indent=2).encode()
    return write_zip(path, {"submission.json": body})


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_report(path: str, report: dict, required: tuple[str, ...] = ()) -> None:
    """A run report or manifest; fails if a required field is missing."""
    if lost := [k for k in required if k not in report]:
        raise ValueError(f"report lacks {lost}")
    write_json(path, report, sort_keys=True)


def write_features(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_embeddings(df: DataFrame, path: str, key: str = "chunk_idx", vector: str = "embedding") -> DataFrame:
    """Vectors keyed by chunk as Parquet, read back; an existing table is reused."""
    spark = df.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        df.select(key, vector).write.parquet(path)
    return spark.read.parquet(path)


def reuse_or_write(spark: SparkSession, path: str, build: Callable[[], DataFrame], valid: Callable[[DataFrame], bool]) -> DataFrame:
    """The table at ``path`` if it is there and ``valid``; else ``build()`` written to it."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        kept = spark.read.parquet(path)
        if valid(kept):
            return kept
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

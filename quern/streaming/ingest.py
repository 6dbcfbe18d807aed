"""Documents that keep arriving: cleaned and cut into windows as they come.

Cleaning and windows are row-wise, so the batch expressions run on a stream
unchanged; files and the checkpoint give each document exactly one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import fixed_values as V
from quern.operators import chunking


def window_stream(spark: SparkSession, path: str, schema: str, text: str = "text", window: int = V.WINDOW_WORDS, overlap: int = V.OVERLAP_WORDS, files_per_batch: int = 64) -> DataFrame:
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return chunking.windows(chunking.clean_text(docs.filter(F.col(text).isNotNull()), text, stats=None), "clean_text", window, overlap)


def write_windows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

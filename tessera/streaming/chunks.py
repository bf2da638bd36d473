"""Chunking over streams: each arriving batch of arrays is cut on its own, without state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunk_batches


def stream_chunks(stream: DataFrame, column: str, chunk_shape: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """Lazy: nothing runs before the stream is started. Works on batch DataFrames alike."""
    return chunk_batches(stream, column, chunk_shape, keep)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: in ``spark.checkpoint.dir``, else in the context's
    own checkpoint folder; only on one machine, where neither is set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


def write_available(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, exactly once, and stop."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Scanning files as they arrive, with Structured Streaming.

The scan is row-local, so it runs on a stream as it does on a table: no state, no watermark, each micro-batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import verify
from ..operators.registry import BUILTIN, Pattern


def arriving_texts(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Stream of (path, content) of whole text files that land in a folder."""
    return spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def arriving_rows(spark: SparkSession, folder: str, schema: str, path: str, content: str, files_a_batch: int = 100) -> DataFrame:
    """Stream of (path, content) of the rows of Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder).select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))


def scanned(stream: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN) -> DataFrame:
    """Stream of findings."""
    return verify.findings(stream, patterns)


def append_findings(stream: DataFrame, out: str, checkpoint: str, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN) -> StreamingQuery:
    """Appends findings to Parquet until what has arrived is done."""
    return scanned(stream, patterns).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_counts(stream: DataFrame, patterns: list[Pattern] | tuple[Pattern, ...] = BUILTIN) -> DataFrame:
    """Streaming counts of findings by severity, for a complete-mode sink."""
    return scanned(stream, patterns).groupBy("severity").agg(F.count("*").alias("findings"))



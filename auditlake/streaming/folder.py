"""Folders that fill up: new files are audited once, as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from auditlake.functions.replies import decode_replies
from auditlake.operators.extract import extracted
from auditlake.schemas import SUFFIXES
from auditlake.sources.files import any_case, described

FILES = "path string, modificationTime timestamp, length long, content binary"


def audit_new_files(spark: SparkSession, folder: str, read: Callable, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a decoded result for every file not seen before to Parquet at out, then ends."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", any_case(SUFFIXES)).load(folder)
    results: DataFrame = decode_replies(extracted(described(files), read))
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

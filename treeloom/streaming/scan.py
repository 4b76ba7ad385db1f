"""Incremental scans: files that arrive in a folder are parsed and queried once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeloom.functions.columns import decode_text
from treeloom.sources.files import parsed

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.java", files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of files as they arrive."""
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return stream.load(path).select("path", decode_text(F.col("content")).alias("text"))


def scan(files: DataFrame, kind: str, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Writes detect(nodes) of every batch below out; a batch that is tried again replaces its own folder, so none counts twice."""

    def batch(df: DataFrame, number: int) -> None:
        detect(parsed(df, kind)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

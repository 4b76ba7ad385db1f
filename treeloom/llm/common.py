"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources.work import file_system, shuffled, work_path
from treeloom.sources.work import written as materialize

__all__ = ["ascii_lower", "bound_batches", "delete_path", "materialize", "shuffled", "slices", "table", "unwrapped", "whole_rows", "work_path"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def delete_path(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def whole_rows(df: DataFrame, *extra: Column) -> DataFrame:
    """The column `row`, a struct of all columns, and the extra ones: a table's own names can't clash with those added later."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of whole_rows again."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows of an Arrow batch: texts can be long, and a batch is held by the JVM and by Python, going in and coming out.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batch size to at most rows; a lower one stays."""
    now = int(spark.conf.get(_BATCH_KEY, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH_KEY, str(rows))

"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at a time: whole texts can be long, so a batch stays small.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches between Spark and Python for operators on whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def narrow_rows(spark: SparkSession, rows: int = 20_000) -> None:
    """Larger batches for rows of a few numbers."""
    small_batches(spark, rows)


def fold(key: str = "doc_id", parts: int = 4):
    """crc32 of a key written as text, modulo `parts`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def texts(frame, column: str = "text") -> Iterator[str]:
    """The texts of a pandas batch, missing ones as empty."""
    return (t if isinstance(t, str) else "" for t in frame[column])


#: A key counts as hot from this part of all rows on, so there are at most as many hot keys.
HOT_PART = 1000


def join_spread(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join `rows` with one row for each key, without gathering a frequent key's rows in one task.

    `keyed` says in `count` how many rows a key has. Keys with more than a thousandth of all rows are at most a
    thousand: they are broadcast and joined where their rows lie. Only the other rows are shuffled.
    """
    edge = max(rows.count() // HOT_PART, 1)
    hot = F.broadcast(keyed.filter(F.col(count) > edge).drop(count))
    rest = keyed.filter(F.col(count) <= edge).drop(count)
    spread = rows.join(hot, on, "left_semi" if how == "left_semi" else "inner")
    return spread.unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on, how))

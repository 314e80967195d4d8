"""What several operators need: tables in the shared folder, batch limits, row checks, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace, python_ready
from kinloom.operators.graph import components

__all__ = ["Workspace", "bounded_batches", "columns_checked", "components", "tidied", "touched"]

#: Hash buckets of keys that may be broadcast.
BUCKETS = 1 << 22
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4000


def tidied(run):
    """run(batches) that gives a worker's free memory back at its end: workers stay for other stages."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return own


def bounded_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches handed to Python by bytes and rows, as texts have no length limit.

    Only memory depends on it, no result. Tighter limits of the session stay. Python workers also get this
    package's folder on their path, where the session's start didn't give it.
    """
    python_ready(spark)
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def columns_checked(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the needed columns, cast to their types: extra columns, whatever their names, stay out of the way."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in needed.items()])


def touched(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: all that may have one of keys(column), and others; rows without a key are among the others.

    Only the keys' buckets under two hashes, at most BUCKETS of each, are broadcast, as a Bloom filter. Where few
    keys are wanted, most rows thus need no shuffle for an exact join with them; where many are, nearly all rows
    are in the first part.
    """
    known, marked = keys.where(F.col(column).isNotNull()), rows
    for name, salt in _MARKS:
        marked = marked.withColumn(name, F.when(F.col(column).isNotNull(), _bucket(column, salt)))
    (one, two), filters = [name for name, _ in _MARKS], [F.broadcast(known.select(_bucket(column, salt).alias(name)).distinct()) for name, salt in _MARKS]
    first = marked.join(filters[0], one, "left_semi")
    others = marked.join(filters[0], one, "left_anti").unionByName(first.join(filters[1], two, "left_anti"))
    return first.join(filters[1], two, "left_semi").drop(one, two), others.drop(one, two)


_MARKS = (("__bucket_1", 1), ("__bucket_2", 2))


def _bucket(column: str, salt: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(BUCKETS))

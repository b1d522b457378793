"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairmill.session import ensure_checkpoint_dir

#: ``[\x20\x09-\x0D]``
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: bytes -> bytes table that lower-cases A-Z and leaves every other byte
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows of an Arrow batch at most; texts are long, and a batch is held on both sides.
BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str, by: Iterable[str] = (), file_rows: int = 0) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint does, but as Parquet: later readers
    prune columns, and Spark knows the size when it chooses a join.  Columns
    ``by`` become folders, so that a filter on them reads its own files, of
    ``file_rows`` rows at most (0: no bound).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: a worker waits for its next task beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_group(run: Callable) -> Callable:
    """A function for ``applyInArrow`` or ``applyInPandas`` that keeps no memory after a group."""
    def tidy(*groups):
        try:
            return run(*groups)
        finally:
            release()
    # Spark tells by the arguments whether a function wants the key
    return (lambda a: tidy(a)) if run.__code__.co_argcount == 1 else (lambda a, b: tidy(a, b))


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of so many rows at most; a smaller bound of the session stays."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= rows:
        spark.conf.set(BATCH_CONF, str(rows))


def regrouped(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, the last of fewer, however Spark sent them."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, rows - n))
            b = b.slice(held[-1].num_rows)
            n += held[-1].num_rows
            if n == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over texts: batches of few rows, and no memory kept by the worker after a task."""
    bound_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()
    return df.mapInArrow(tidy, schema)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, each lengthened until no taken name (case aside) equals it."""
    used = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in used:
            w += "_"
        used.add(w.lower())
        out.append(w)
    return out


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else.

    ``lower`` is far cheaper than ``translate`` and equal to it where no upper
    or title case character stands outside ASCII.
    """
    other_case = c.rlike(r"[^\x00-\x7F&&[\p{IsUppercase}\p{Lt}]]")
    return F.when(other_case, F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (a null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor

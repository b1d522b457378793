"""Deep pages of a sorted table (O1).

``offset`` in a plan sorts and skips all rows before the page.  Here a table is
written once in sort order, cut into ranges that carry each row's place inside
its range, with an index of one row a range (first place, rows).  A page of any
depth then reads the ranges it overlaps, and inside them the row groups whose
places it asks for.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scalar
from ..sources.io import path_exists

RANGE_ROWS = 1_000_000
PART, AT = "__range", "__at"


def write_pages(df: DataFrame, order: list[Column], path: str, range_rows: int = RANGE_ROWS) -> int:
    """Write ``df`` sorted by ``order`` below ``path``; returns the number of rows.

    ``order`` must be a total order (end it with a unique key), which also lets
    a value that a third of all rows share fall into many ranges.  Ranges hold
    about ``range_rows`` rows.  ``path`` must be new: a page table is written
    once and read until the next one takes its place.  The index is written
    last; a writer that was lost before leaves a folder that ``open_pages``
    refuses.  An empty frame gives an empty table.
    """
    if path_exists(df.sparkSession, path):
        raise ValueError(f"{path} is there already: write pages to a new folder")
    taken = {PART, AT} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the page table's own")
    path = path.rstrip("/")
    n = int(scalar(df.agg(F.count(F.lit(1)))) or 0)
    ranges = max(1, -(-n // range_rows))
    placed = (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                .withColumn(PART, F.spark_partition_id())
                .withColumn(AT, F.monotonically_increasing_id() - F.shiftleft(F.col(PART).cast("long"), 33)))
    placed.write.partitionBy(PART).parquet(f"{path}/rows")
    # the schema is kept: an empty table has no files to take it from
    spark, schema = df.sparkSession, placed.schema
    spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.text(f"{path}/schema")
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    sizes = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    index = sizes.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long"))
    index.coalesce(1).write.parquet(f"{path}/ranges")
    return n


def open_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (with their range and place) and the index of a page table."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/ranges/_SUCCESS"):
        raise ValueError(f"{path} holds no finished page table")
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return (spark.read.schema(schema).parquet(f"{path}/rows"),
            spark.read.schema(f"{PART} int, rows long, first long").parquet(f"{path}/ranges"))


def total_rows(spark: SparkSession, path: str) -> int:
    """Rows of a page table, from its index."""
    return int(scalar(open_pages(spark, path)[1].agg(F.sum("rows"))) or 0)


def read_page(spark: SparkSession, path: str, offset: int, limit: int, place: str | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the table's order, in order.

    Only the ranges that overlap the page are read; one index row for each of
    those comes to the driver.  A page beyond the end is empty.  With ``place``,
    that column holds the row's place in the whole table.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    rows, index = open_pages(spark, path)
    end = offset + limit
    hit = index.filter((F.col("first") < end) & (F.col("first") + F.col("rows") > offset)).collect() if limit else []
    wanted = F.lit(False)
    start = F.lit(None).cast("long")
    for r in hit:
        inside = (F.col(PART) == r[PART]) & (F.col(AT) >= max(0, offset - r["first"])) & (F.col(AT) < end - r["first"])
        wanted = inside if r is hit[0] else wanted | inside
        start = F.when(F.col(PART) == r[PART], F.lit(r["first"])).otherwise(start)
    out = rows.filter(wanted).withColumn("__place", start + F.col(AT)).orderBy("__place")
    cols = [c for c in rows.columns if c not in (PART, AT)]
    return out.select(*cols, *([F.col("__place").alias(place)] if place else []))

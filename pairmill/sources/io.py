"""Sources and sinks: typed reads, appends, keyed upserts with
staged writes, key-idempotent caches."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV (header, quoted multi-line fields); a glob reads many."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_many_by_name(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Stack differing files by column name (missing columns → null)."""
    out = None
    for p in paths:
        df = spark.read.format(fmt).load(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def loaded_partitions(df: DataFrame, pattern: str, name: str = "part") -> DataFrame:
    """S3: which partitions are loaded, from the input file names."""
    return (df.select(F.regexp_extract(F.input_file_name(), pattern, 1).alias(name))
              .filter(F.col(name) != "").distinct())


def write_dated(df: DataFrame, base: str, name: str, fmt: str = "parquet",
                stamp: str | None = None, mode: str = "overwrite") -> str:
    """Write under an optional timestamp-suffixed folder; returns the path."""
    path = f"{base.rstrip('/')}/{name}"
    if stamp is not None:
        path += "_" + (stamp or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S"))
    df.write.mode(mode).format(fmt).save(path)
    return path


def append(df: DataFrame, path: str, fmt: str = "parquet", with_created_at: bool = False) -> None:
    """Append (optionally stamping ``created_at``)."""
    out = df.withColumn("created_at", F.current_timestamp()) if with_created_at else df
    out.write.mode("append").format(fmt).save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_if_empty(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write only when the table is missing or has no rows; tells whether it wrote."""
    spark = df.sparkSession
    if path_exists(spark, path) and not spark.read.schema(df.schema).format(fmt).load(path).isEmpty():
        return False
    df.write.mode("overwrite").format(fmt).save(path)
    return True


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, plus ``new`` (by
    name; columns missing on one side become null).  With ``order_col`` a row
    of ``new`` that is older than the one it would replace is left out (equal
    times: the new row counts, a null time is oldest); without it, arrival
    decides."""
    if order_col is not None:
        held = old.groupBy(*keys).agg(F.max(order_col).alias("__held"))
        match = [new[k].eqNullSafe(held[k]) for k in keys]
        new = new.join(held, match, "left").filter(
            F.col("__held").isNull() | F.coalesce(new[order_col] >= F.col("__held"), F.lit(False))).select(*[new[c] for c in new.columns])
    hit = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    kept = old.join(hit, [old[k].eqNullSafe(hit[f"__{k}"]) for k in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version_path: str,
                 order_col: str | None = None) -> str:
    """Upsert into a table by writing the merged result to a fresh
    ``version_path`` (never overwriting the folder being read); the caller
    swaps a pointer/catalog entry to the returned path.  Only a missing table
    counts as a first load; any other error rises."""
    merged = upsert(spark.read.parquet(path), new, keys, order_col) if path_exists(spark, path) else new.select(*new.columns)
    missing = [k for k in keys if k not in new.columns]
    if missing:
        raise ValueError(f"key columns missing in the new rows: {missing}")
    merged.write.mode("overwrite").parquet(version_path)
    return version_path


def truncate(df: DataFrame, path: str) -> None:
    """Overwrite with an empty frame of the same schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def evolve_schema(df: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Add columns with a default (0.0), keep existing values."""
    out = df
    for c, v in columns.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in out.columns else out.withColumn(c, F.lit(v))
    return out


def missing_keys(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose derived vectors are not cached yet (compute only these)."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def to_json_docs(df: DataFrame, id_col: str, defaults: dict) -> DataFrame:
    """Every row → a JSON feature document, nulls replaced by defaults."""
    fields = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()]
    return df.select(id_col, F.to_json(F.struct(*fields)).alias("features_json"))


def normalize_rows(df: DataFrame, strings: list[str] = (), arrays: list[str] = (), numbers: list[str] = (),
                   timestamps: dict[str, str] | None = None, source: str | None = None) -> DataFrame:
    """Fixed row layout for parsed records — missing strings → '',
    arrays → [], numbers and dates coerced with ``try_*`` (bad → null), plus
    ``source`` and ``parsed_date``."""
    out = df
    for c in strings:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in out.columns \
            else out.withColumn(c, F.lit(""))
    for c in arrays:
        empty = F.array().cast("array<string>")
        out = out.withColumn(c, F.coalesce(F.col(c), empty)) if c in out.columns else out.withColumn(c, empty)
    for c in numbers:
        out = out.withColumn(c, F.col(c).try_cast("double")) if c in out.columns \
            else out.withColumn(c, F.lit(None).cast("double"))
    for c, fmt in (timestamps or {}).items():
        out = out.withColumn(c, F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt))) if c in out.columns \
            else out.withColumn(c, F.lit(None).cast("timestamp"))
    if source is not None:
        out = out.withColumn("source", F.lit(source))
    return out.withColumn("parsed_date", F.current_timestamp())


def export_top(df: DataFrame, score: str, path: str, n: int = 20, id_col: str | None = None) -> None:
    """The ``n`` best rows by score written as one CSV (a bounded
    report: TakeOrderedAndProject, then a single small file)."""
    order = [F.desc(score)] + ([F.asc(id_col)] if id_col else [])
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

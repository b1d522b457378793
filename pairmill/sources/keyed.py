"""Keyed tables whose upserts rewrite only the buckets they touch (S10, X18, ST1).

A row lies in the bucket that the hash of its key names.  An upsert reads the
buckets in which its keys fall, writes those anew in a folder of its own and
commits by renaming one small manifest file that lists, for each bucket, the
folder that holds it.  Until then readers see the table as it was; what a lost
writer leaves behind is named by no manifest, and ``expire`` removes it.

The number of buckets is fixed when the table is made: choose it so that one
bucket, which one task writes, holds some hundred megabytes.  The manifest has
one line a bucket.  Two writers may not commit the same number: the later one
gets an error and upserts again.  On stores whose rename is no single step
(plain object stores) only one writer may be at work.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint
from .io import upsert

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """What one commit says: ``folders`` maps a bucket to its folder, ``runs`` a writer to its last epoch."""

    number: int
    keys: list[str]
    buckets: int
    schema: StructType
    folders: dict[int, str]
    runs: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"keys": self.keys, "buckets": self.buckets, "schema": json.loads(self.schema.json()),
                           "folders": self.folders, "runs": self.runs})


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return [st.getPath().getName() for st in fs.listStatus(at)] if fs.exists(at) else []


def _numbers(spark: SparkSession, table_dir: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{table_dir}/manifests") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, table_dir: str, number: int | None = None) -> Manifest | None:
    """The newest commit (or that of this number); None where there is no table."""
    table_dir = table_dir.rstrip("/")
    if number is None:
        found = _numbers(spark, table_dir)
        if not found:
            return None
        number = found[-1]
    got = json.loads(spark.read.text(f"{table_dir}/manifests/{number}.json", wholetext=True).first()[0])
    return Manifest(number, got["keys"], got["buckets"], StructType.fromJson(got["schema"]),
                    {int(b): f for b, f in got["folders"].items()}, got["runs"])


def _commit(spark: SparkSession, table_dir: str, m: Manifest) -> None:
    fs, draft = _fs(spark, f"{table_dir}/manifests/draft-{uuid.uuid4().hex}")
    _, final = _fs(spark, f"{table_dir}/manifests/{m.number}.json")
    out = fs.create(draft, False)
    out.write(bytearray(m.text().encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"commit {m.number} of {table_dir} was taken by another writer: upsert again")


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, table_dir: str, m: Manifest, wanted: list[int]) -> DataFrame:
    paths = [f"{table_dir}/data/{m.folders[b]}" for b in wanted if b in m.folders]
    return spark.read.schema(m.schema).parquet(*paths) if paths else spark.createDataFrame([], m.schema)


def read_keyed(spark: SparkSession, table_dir: str, number: int | None = None) -> DataFrame | None:
    """The table as the newest commit (or an older one that is still kept) names it."""
    table_dir = table_dir.rstrip("/")
    m = manifest(spark, table_dir, number)
    return None if m is None else _read(spark, table_dir, m, sorted(m.folders))


def _touched(df: DataFrame, column) -> list[int]:
    """Buckets that rows fall in: at most one number a bucket comes to the driver."""
    return sorted(r[0] for r in df.select(column.alias("b")).distinct().collect())


def lookup(spark: SparkSession, table_dir: str, wanted: DataFrame) -> DataFrame | None:
    """Rows whose key stands in ``wanted``; reads only the buckets of those keys."""
    table_dir = table_dir.rstrip("/")
    m = manifest(spark, table_dir)
    if m is None:
        return None
    keys = wanted.select(*[F.col(k).cast(m.schema[k].dataType).alias(f"__{k}") for k in m.keys]).distinct()
    rows = _read(spark, table_dir, m, _touched(keys, _bucket([f"__{k}" for k in m.keys], m.buckets)))
    return rows.join(keys, [rows[k].eqNullSafe(keys[f"__{k}"]) for k in m.keys], "left_semi")


def _merged_schema(old: StructType, new: StructType) -> StructType:
    """Fields of the table, then the new ones; all may be null, as old files lack the new ones."""
    names = set(old.fieldNames())
    out = StructType()
    for f in [*old.fields, *(f for f in new.fields if f.name not in names)]:
        out.add(f.name, f.dataType, True)
    return out


def upsert_keyed(new: DataFrame, table_dir: str, keys: list[str], order_col: str | None = None, buckets: int = BUCKETS,
                 run: str | None = None, epoch: int = 0) -> list[int]:
    """Upsert ``new`` (one row a key) and return the buckets written.

    Rows replace those of their key as in ``io.upsert``: with ``order_col`` an
    older row does not replace a newer one.  Null keys are keys.  New columns
    are null in old rows, missing ones null in new rows; a column whose type
    differs is cast to the table's.  An empty ``new`` makes the table if there
    is none and rewrites nothing else.  With ``run``, an epoch that this run
    has committed before is left out, so a replay changes nothing.
    """
    spark, table_dir = new.sparkSession, table_dir.rstrip("/")
    missing = [k for k in keys if k not in new.columns]
    if missing:
        raise ValueError(f"key columns missing in the new rows: {missing}")
    m = manifest(spark, table_dir)
    if m is None:
        m = Manifest(-1, keys, buckets, _merged_schema(StructType(), new.schema), {})
    elif m.keys != keys:
        raise ValueError(f"the table has the keys {m.keys}, not {keys}")
    if run is not None and m.runs.get(run, -1) >= epoch:
        return []
    schema = _merged_schema(m.schema, new.schema)
    # read several times below: the batch is computed once
    new = checkpoint(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in new.columns]))
    touched = _touched(new, _bucket(keys, m.buckets))
    number = m.number + 1
    folders = dict(m.folders)
    if touched:
        merged = upsert(_read(spark, table_dir, m, touched), new, keys, order_col).select(*schema.fieldNames())
        part = "bucket"
        while part.lower() in {c.lower() for c in schema.fieldNames()}:
            part += "_"
        folder = f"{number}-{uuid.uuid4().hex}"
        (merged.withColumn(part, _bucket(keys, m.buckets)).repartition(part)
               .write.partitionBy(part).parquet(f"{table_dir}/data/{folder}"))
        folders |= {b: f"{folder}/{part}={b}" for b in touched}
    runs = m.runs if run is None else m.runs | {run: epoch}
    _commit(spark, table_dir, Manifest(number, keys, m.buckets, schema, folders, runs))
    return touched


def expire(spark: SparkSession, table_dir: str, keep: int = 2) -> int:
    """Remove all but the ``keep`` newest commits and the bucket folders that none of those names.

    Returns the number of bucket folders removed.  Folders of a number beyond
    the newest commit may be a writer's at work and stay.
    """
    table_dir = table_dir.rstrip("/")
    numbers = _numbers(spark, table_dir)
    if not numbers or keep < 1:
        return 0
    used = {f for n in numbers[-keep:] for f in manifest(spark, table_dir, n).folders.values()}
    for n in numbers[:-keep]:
        fs, at = _fs(spark, f"{table_dir}/manifests/{n}.json")
        fs.delete(at, False)
    gone = 0
    for folder in _names(spark, f"{table_dir}/data"):
        if int(folder.split("-")[0]) > numbers[-1]:
            continue
        parts = [n for n in _names(spark, f"{table_dir}/data/{folder}") if "=" in n]
        old = [n for n in parts if f"{folder}/{n}" not in used]
        for n in old if len(old) < len(parts) else [""]:
            fs, at = _fs(spark, f"{table_dir}/data/{folder}/{n}".rstrip("/"))
            fs.delete(at, True)
        gone += len(old)
    return gone

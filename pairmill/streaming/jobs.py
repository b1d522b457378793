"""Incremental upkeep as Structured Streaming.

The reference runs scheduled batch jobs; here they are streaming queries
over landed files with ``trigger(availableNow=True)`` for catch-up runs:

* ST1 ``snapshot_upsert_stream`` — new snapshot files → newest row per key
  inside the micro-batch (W1) → keyed upsert that rewrites the buckets it touches.
* ST2 ``fill_missing_vectors_stream`` — only rows whose (id, model) has no
  vector yet are encoded (pluggable ``mapInPandas`` encoder) and appended.
* ST3 ``recent_activity_counts`` — watermarked daily window counts (the
  retrain gate).
* ST4 ``enrich_decisions_stream`` — stream-static join of decisions with the
  résumé snapshot, duplicates dropped within the watermark.
* ST5 ``service_stats_stream`` — windowed latency statistics with bounded
  memory (``percentile_approx``); exact quantiles stay batch (A13).

Every sink is idempotent by run and micro-batch id (a replayed epoch is
skipped or overwrites its own folder).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.rank import latest_per_key
from ..sources.io import path_exists
from ..sources.keyed import BUCKETS, expire, read_keyed, upsert_keyed


def read_versioned(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The table that ``snapshot_upsert_stream`` keeps; None before its first commit."""
    return read_keyed(spark, table_dir)


def snapshot_upsert_stream(spark: SparkSession, source_dir: str, schema: StructType | str, table_dir: str,
                           keys: list[str], order_col: str, tiebreak: list[str], checkpoint_dir: str,
                           max_files: int | None = None, buckets: int = BUCKETS, keep: int = 2):
    """ST1: landed snapshot files → upsert by ``keys`` into ``table_dir``.

    Each micro-batch is reduced to its newest row per key and upserted (a held
    row that is newer by ``order_col`` stays); only the buckets of its keys are
    written (``sources.keyed``), and the ``keep`` newest commits stay readable.
    A commit carries the run (by its checkpoint folder) and epoch, so a
    replayed epoch changes nothing and a new checkpoint folder hides nothing."""
    stream = spark.readStream.schema(schema)
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    stream = stream.parquet(source_dir)
    run = hashlib.md5(checkpoint_dir.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, epoch: int) -> None:
        new = latest_per_key(batch, keys, order_col, ties="one", tiebreak=tiebreak)
        upsert_keyed(new, table_dir, keys, order_col, buckets, run, epoch)
        expire(spark, table_dir, keep)

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def fill_missing_vectors_stream(spark: SparkSession, source_dir: str, schema: StructType | str, vectors_dir: str,
                                id_col: str, text_col: str, model_name: str, encoder, out_schema: str,
                                checkpoint_dir: str):
    """ST2/T15: encode only rows whose (id, model_name) has no vector and
    whose text is non-empty; append.  ``encoder`` is an
    ``Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]`` for ``mapInPandas``
    (the model is loaded once per task)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    run = hashlib.md5(checkpoint_dir.encode()).hexdigest()[:12]  # epochs restart per checkpoint

    def fill(batch: DataFrame, epoch: int) -> None:
        todo = batch.filter(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(id_col, text_col) \
                    .dropDuplicates([id_col])
        if path_exists(spark, vectors_dir):
            have = spark.read.parquet(vectors_dir).filter(F.col("model_name") == model_name).select(id_col)
            todo = todo.join(have, id_col, "left_anti")
        enc = todo.mapInPandas(encoder, out_schema).withColumn("model_name", F.lit(model_name))
        # one folder per (run, epoch), overwritten on replay → idempotent append
        enc.write.mode("overwrite").parquet(f"{vectors_dir.rstrip('/')}/run={run}/epoch={epoch}")

    return (stream.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; NTZ event times are read in the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def recent_activity_counts(events: DataFrame, ts: str, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """ST3: watermarked tumbling-window counts (streaming or batch frame)."""
    return (_event_time(events, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))


def enrich_decisions_stream(decisions: DataFrame, resumes: DataFrame, ts: str, keys: list[str],
                            watermark: str = "1 hour") -> DataFrame:
    """ST4: stream-static join with the résumé snapshot; duplicate decisions
    dropped within the watermark."""
    d = _event_time(decisions, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return d.join(resumes, "resume_id", "left")


def service_stats_stream(log: DataFrame, ts: str, value: str, window: str = "1 hour",
                         watermark: str = "2 hours") -> DataFrame:
    """ST5: windowed count / mean / approximate p50-p95-p99 / min / max."""
    q = F.percentile_approx(value, [0.5, 0.95, 0.99], 10000)
    return (_event_time(log, ts).withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"))
               .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q.alias("q"),
                    F.min(value).alias("min"), F.max(value).alias("max"))
               .select(F.col("w.start").alias("window_start"), "n", "mean",
                       F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"),
                       "min", "max"))


def hashed_ngram_encoder(dim: int = 64, n: int = 3):
    """T14 built-in encoder for ``mapInPandas``: hashed byte n-grams of the
    lower-cased UTF-8 text (a polynomial rolling hash, vectorised with
    numpy), counts pooled into ``dim`` buckets and L2-normalised.  A
    stand-in for a sentence encoder: any callable with the same signature
    (batches of (id, text) → (id, embedding)) can replace it, e.g. one that
    loads a model once per task."""
    import numpy as np
    import pandas as pd

    weights = np.array([257 ** (n - 1 - j) for j in range(n)], dtype=np.int64)

    def one(text: str) -> list[float]:
        b = np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8).astype(np.int64)
        if len(b) < n:
            return [0.0] * dim
        grams = sum(b[j:len(b) - n + 1 + j] * weights[j] for j in range(n))
        v = np.bincount((grams * 2654435761) % 4294967291 % dim, minlength=dim).astype(np.float64)
        nv = np.linalg.norm(v)
        return (v / nv if nv > 0 else v).astype(np.float32).tolist()

    def enc(batches):
        for pdf in batches:
            texts = pdf.iloc[:, 1].fillna("").astype(str)
            yield pd.DataFrame({pdf.columns[0]: pdf.iloc[:, 0], "embedding": [one(t) for t in texts]})
    return enc

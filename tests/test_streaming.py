"""Streaming upkeep: an availableNow run over day-split files equals the
batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from pairmill.operators.rank import latest_per_key
from pairmill.streaming.jobs import read_versioned, recent_activity_counts, snapshot_upsert_stream

SF = "/root/testdata/sf0.001"


def test_snapshot_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="st1-")
    ev = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("source"),
        F.date_trunc("day", "ts").alias("parsed_date"), "event_id", "value", F.dayofmonth("ts").alias("day"))
    src = os.path.join(base, "landing")
    for day in (5, 15, 31):  # three landed batches
        (ev.filter((F.col("day") <= day) & (F.col("day") > day - 10 if day != 31 else F.col("day") > 15))
           .drop("day").write.mode("overwrite").parquet(os.path.join(src, f"batch={day}")))
    schema = "id string, source string, parsed_date timestamp, event_id long, value double"
    q = snapshot_upsert_stream(spark, src + "/*", schema, os.path.join(base, "table"), ["id", "source"],
                               "parsed_date", ["event_id"], os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = read_versioned(spark, os.path.join(base, "table"))
    batch_src = spark.read.schema(schema).parquet(src + "/*")
    assert got is not None and got.count() > 0
    # batches are time-ordered, so the streamed upserts equal one batch
    # "newest row per key" over everything that landed
    want = latest_per_key(batch_src, ["id", "source"], "parsed_date", "one", ["event_id"])
    cols = ["id", "source", "parsed_date", "event_id", "value"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_recent_activity_window_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    w = recent_activity_counts(ev, "ts")
    assert w.agg(F.sum("n")).collect()[0][0] == ev.count()
    assert latest_per_key(ev.select(F.col("user_id").alias("k"), "ts", "event_id"), ["k"], "ts").count() == \
        ev.select("user_id").distinct().count()


def test_fill_missing_vectors_idempotent(spark):
    from pairmill.streaming.jobs import fill_missing_vectors_stream, hashed_ngram_encoder
    base = tempfile.mkdtemp(prefix="st2-")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")
    src = os.path.join(base, "landing")
    docs.write.mode("overwrite").parquet(os.path.join(src, "batch=1"))
    schema = "id string, text string"
    out_schema = "id string, embedding array<float>"
    vec = os.path.join(base, "vectors")
    for run in range(2):  # the second run must add nothing
        q = fill_missing_vectors_stream(spark, src + "/*", schema, vec, "id", "text", "hash64",
                                        hashed_ngram_encoder(64), out_schema, os.path.join(base, f"ckpt{run}"))
        q.awaitTermination(300)
    got = spark.read.parquet(vec)
    want = docs.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("id").distinct().count()
    assert got.count() == want and got.select("id").distinct().count() == want
    assert got.select(F.size("embedding")).distinct().first()[0] == 64


def test_enrich_and_stats_streams(spark):
    from pairmill.streaming.jobs import enrich_decisions_stream, service_stats_stream
    base = tempfile.mkdtemp(prefix="st45-")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    src = os.path.join(base, "events")
    ev.unionByName(ev.limit(50)).write.mode("overwrite").parquet(src)  # replayed duplicates
    stream = spark.readStream.schema(ev.schema).parquet(src)
    res = spark.read.parquet(f"{SF}/customer.parquet").select(F.col("c_custkey").cast("string").alias("resume_id"),
                                                             "c_mktsegment")
    dec = stream.select(F.col("event_id"), F.col("user_id").cast("string").alias("resume_id"), "ts")
    enriched = enrich_decisions_stream(dec, res, "ts", ["event_id"], "1 hour")
    q1 = enriched.writeStream.format("memory").queryName("st4_out").outputMode("append").trigger(availableNow=True).start()
    q1.awaitTermination(300)
    assert spark.sql("SELECT count(DISTINCT event_id) c, count(*) n FROM st4_out").first() == (ev.count(), ev.count())
    stats = service_stats_stream(stream, "ts", "value", "1 day", "1 day")
    q2 = stats.writeStream.format("memory").queryName("st5_out").outputMode("complete").trigger(availableNow=True).start()
    q2.awaitTermination(300)
    assert spark.sql("SELECT sum(n) FROM st5_out").first()[0] == ev.count() + 50

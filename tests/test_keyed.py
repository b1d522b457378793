"""Keyed tables: upserts equal the plain form, rewrite only what they touch, and commit in one step."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pairmill.sources import keyed
from pairmill.sources.io import upsert

SCHEMA = "id long, t long, v string"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _files(path):
    return {os.path.join(at, n) for at, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_equals_plain_upserts(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "t")
    plain = spark.createDataFrame([], SCHEMA)
    for step in range(4):
        ids = rng.sample([*range(40), None], 15)
        new = spark.createDataFrame([(i, rng.randrange(5), f"{step}-{i}") for i in ids], SCHEMA)
        plain = spark.createDataFrame(upsert(plain, new, ["id"], "t").collect(), SCHEMA)
        keyed.upsert_keyed(new, path, ["id"], "t", buckets=8)
        assert _rows(keyed.read_keyed(spark, path)) == _rows(plain)


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(1000).select("id", F.lit(1).cast("long").alias("t"), F.lit("a").alias("v"))
    assert keyed.upsert_keyed(base, path, ["id"], buckets=16) == list(range(16))
    before = _files(f"{path}/data")
    written = keyed.upsert_keyed(spark.createDataFrame([(7, 2, "b")], SCHEMA), path, ["id"], buckets=16)
    after = _files(f"{path}/data")
    assert len(written) == 1 and before <= after
    assert {p.split("bucket=")[1].split("/")[0] for p in after - before} == {str(written[0])}
    old, new = keyed.manifest(spark, path, 0).folders, keyed.manifest(spark, path).folders
    assert [b for b in range(16) if old[b] != new[b]] == written
    assert keyed.read_keyed(spark, path).count() == 1000
    assert _rows(keyed.read_keyed(spark, path, 0).where("id = 7")) == [(7, 1, "a")]
    found = keyed.lookup(spark, path, spark.createDataFrame([(7,), (8,), (5000,)], "id long"))
    assert _rows(found) == [(7, 2, "b"), (8, 1, "a")]
    assert sum("bucket=" in f for f in found.inputFiles()) <= 3


def test_crash_before_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.upsert_keyed(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), path, ["id"], buckets=4)

    def lost(*_):
        raise RuntimeError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", lost)
        with pytest.raises(RuntimeError):
            keyed.upsert_keyed(spark.createDataFrame([(1, 2, "b")], SCHEMA), path, ["id"])
    assert _rows(keyed.read_keyed(spark, path)) == [(1, 1, "a"), (2, 1, "a")]
    keyed.upsert_keyed(spark.createDataFrame([(1, 3, "c")], SCHEMA), path, ["id"])
    assert _rows(keyed.read_keyed(spark, path)) == [(1, 3, "c"), (2, 1, "a")]
    # what the lost writer and the replaced commit left goes, what is named stays
    assert keyed.expire(spark, path, keep=1) == 2
    assert _rows(keyed.read_keyed(spark, path)) == [(1, 3, "c"), (2, 1, "a")]
    assert {p.split("/data/")[1].rsplit("/", 1)[0] for p in _files(f"{path}/data")} == set(keyed.manifest(spark, path).folders.values())


def test_second_writer_of_a_number_gets_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert_keyed(spark.createDataFrame([(1, 1, "a")], SCHEMA), path, ["id"], buckets=4)
    with pytest.raises(RuntimeError):
        keyed._commit(spark, path, keyed.manifest(spark, path))
    assert _rows(keyed.read_keyed(spark, path)) == [(1, 1, "a")]


def test_columns_empty_batches_and_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.read_keyed(spark, path) is None and keyed.lookup(spark, path, spark.range(1)) is None
    assert keyed.upsert_keyed(spark.createDataFrame([], SCHEMA), path, ["id"], buckets=4) == []
    assert _rows(keyed.read_keyed(spark, path)) == []
    keyed.upsert_keyed(spark.createDataFrame([(1, 1, "a")], SCHEMA), path, ["id"], run="r", epoch=0)
    assert keyed.upsert_keyed(spark.createDataFrame([(1, 1, "replay")], SCHEMA), path, ["id"], run="r", epoch=0) == []
    wide = spark.createDataFrame([(2, "x", 5)], "id int, bucket string, t int")
    keyed.upsert_keyed(wide, path, ["id"], run="r", epoch=1)
    got = keyed.read_keyed(spark, path)
    assert got.columns == ["id", "t", "v", "bucket"] and dict(got.dtypes)["t"] == "bigint"
    assert _rows(got) == [(1, 1, "a", None), (2, 5, None, "x")]
    with pytest.raises(ValueError):
        keyed.upsert_keyed(wide, path, ["bucket"])
    with pytest.raises(ValueError):
        keyed.upsert_keyed(wide.drop("id"), path, ["id"])

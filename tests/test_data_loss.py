"""No row is lost by a wrong key, a new checkpoint folder, a late snapshot or a null target."""

import os

import pytest

from pairmill.sources.io import load_if_empty, upsert, upsert_table
from pairmill.streaming.jobs import read_versioned, snapshot_upsert_stream

SCHEMA = "id long, t long, v string"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_wrong_key_is_an_error(spark, tmp_path):
    base = str(tmp_path / "t")
    spark.createDataFrame([(1, 1, "a")], SCHEMA).write.parquet(base)
    bad = spark.createDataFrame([(2, 1, "b")], "ident long, t long, v string")
    with pytest.raises(Exception):
        upsert_table(spark, base, bad, ["id"], str(tmp_path / "v2"))
    assert not os.path.exists(tmp_path / "v2")
    upsert_table(spark, str(tmp_path / "none"), spark.createDataFrame([(3, 1, "c")], SCHEMA), ["id"], str(tmp_path / "v3"))
    assert _rows(spark.read.parquet(str(tmp_path / "v3"))) == [(3, 1, "c")]


def test_older_rows_do_not_replace_newer(spark):
    old = spark.createDataFrame([(1, 5, "new"), (2, 5, "x"), (None, 1, "n")], SCHEMA)
    new = spark.createDataFrame([(1, 3, "late"), (2, 5, "y"), (3, 1, "z"), (None, 2, "m")], SCHEMA)
    got = {r["id"]: r["v"] for r in upsert(old, new, ["id"], "t").collect()}
    assert got == {1: "new", 2: "y", 3: "z", None: "m"}
    assert {r["v"] for r in upsert(old, new, ["id"]).collect()} == {"late", "y", "z", "m"}


def test_new_checkpoint_folder_hides_nothing(spark, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    for k, rows in enumerate([[(1, 1, "a")], [(2, 1, "b"), (1, 0, "late")]]):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{src}{k}")
        q = snapshot_upsert_stream(spark, f"{src}{k}", SCHEMA, table, ["id"], "t", ["v"], str(tmp_path / f"ck{k}"))
        q.awaitTermination()
    assert _rows(read_versioned(spark, table)) == [(1, 1, "a"), (2, 1, "b")]


def test_load_if_empty(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, 1, "a")], SCHEMA)
    assert load_if_empty(df.limit(0), path) and load_if_empty(df, path) and not load_if_empty(df, path)
    assert _rows(spark.read.parquet(path)) == [(1, 1, "a")]

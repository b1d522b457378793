"""Page tables: equal to a plain sort at any depth, read only the ranges of the page."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pairmill.operators.paging import PART, read_page, total_rows, write_pages



def order():
    return [F.desc("t"), F.desc("id")]


def _frame(spark, n=5000):
    rng = random.Random(5)
    # one time holds a third of the rows, some have none
    rows = [(i, None if i % 50 == 0 else 7 if i % 3 == 0 else rng.randrange(400), f"v{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, t long, v string").repartition(6)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True)


def test_pages_equal_a_plain_sort(spark, tmp_path):
    df, path = _frame(spark), str(tmp_path / "p")
    assert write_pages(df, order(), path, range_rows=400) == 5000 == total_rows(spark, path)
    want = _sorted(df)
    for offset, limit in [(0, 20), (395, 30), (2500, 1300), (4500, 50), (4990, 50), (5000, 10), (9000, 5), (10, 0)]:
        got = read_page(spark, path, offset, limit, "place").collect()
        assert [tuple(r)[:3] for r in got] == want[offset:offset + limit]
        assert [r.place for r in got] == list(range(offset, min(5000, offset + limit)))[:len(got)]


def test_deep_page_reads_its_ranges_only(spark, tmp_path):
    df, path = _frame(spark), str(tmp_path / "p")
    write_pages(df, order(), path, range_rows=400)
    folders = [n for n in os.listdir(f"{path}/rows") if n.startswith(PART)]
    assert len(folders) >= 10  # the value of a third of all rows does not fill one range
    sizes = spark.read.parquet(f"{path}/ranges").agg(F.max("rows")).first()[0]
    assert sizes < 5000 / 3
    want = _sorted(df)[4500:4520]
    first = {r[PART]: r["first"] for r in spark.read.parquet(f"{path}/ranges").collect()}
    hit = {p for p, f in first.items() if f < 4520} - {p for p, f in first.items() if f < 4500 - sizes}
    assert len(hit) <= 4
    for name in folders:  # nothing outside the page's ranges is opened
        if int(name.split("=")[1]) not in hit:
            for f in os.listdir(f"{path}/rows/{name}"):
                if f.endswith(".parquet"):
                    with open(f"{path}/rows/{name}/{f}", "wb") as out:
                        out.write(b"broken")
    page = read_page(spark, path, 4500, 20)
    assert [tuple(r) for r in page.collect()] == want
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert PART in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_unfinished_and_taken(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, t long, v string")
    write_pages(empty, order(), str(tmp_path / "e"))
    assert total_rows(spark, str(tmp_path / "e")) == 0
    page = read_page(spark, str(tmp_path / "e"), 0, 10)
    assert page.columns == ["id", "t", "v"] and page.collect() == []
    with pytest.raises(ValueError):
        write_pages(empty, order(), str(tmp_path / "e"))
    os.makedirs(tmp_path / "u" / "rows")
    with pytest.raises(ValueError):
        read_page(spark, str(tmp_path / "u"), 0, 10)
    with pytest.raises(ValueError):
        write_pages(empty.withColumn("__at", F.lit(1)), order(), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        read_page(spark, str(tmp_path / "e"), -1, 10)

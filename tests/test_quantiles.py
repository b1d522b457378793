"""Exact quantiles of many columns: against numpy, with values that differ in their last bits only."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairmill.operators.quantiles import profile, with_order_key

PROBS = {"q0": 0.0, "q25": 0.25, "median": 0.5, "q95": 0.95, "q100": 1.0}


def _place(x):
    if math.isnan(x):
        return 0x7FF0000000000001
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
         float("inf"), float("-inf"), float("nan"), math.nextafter(1, 0), math.nextafter(1, 2), math.nextafter(2, 0), 8.0, math.nextafter(8, 0),
         1e300, 0.1, 1 / 3, 2.0**52, 2.0**53 - 1, 2.0**-1022 * 1.5, math.nextafter(2.0**1000, 0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(width=64), min_size=1, max_size=300))
def test_order_key(spark, xs):
    xs = EDGES + xs
    got = with_order_key(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), "x", "k").collect()
    assert {r["i"]: r["k"] for r in got} == {i: _place(x) for i, x in enumerate(xs)}


def _check(df, columns):
    got = {r["column"]: r for r in profile(df, list(columns), PROBS).collect()}
    assert list(got) == list(columns)
    for c, xs in columns.items():
        xs = [x for x in xs if x is not None]
        assert got[c]["count"] == len(xs)
        if not xs:
            assert all(got[c][n] is None for n in [*PROBS, "mean", "std", "min", "max"])
            continue
        for n, p in PROBS.items():
            assert got[c][n] == pytest.approx(float(np.quantile(xs, p)), rel=1e-15, abs=0)


def test_many_columns(spark):
    rng = np.random.default_rng(5)
    n = 3000
    close = 1 + rng.integers(0, 40, n) * 2.0**-52  # all sixteen-bit steps but the last agree
    cols = {
        "plain": rng.normal(size=n).tolist(), "close": close.tolist(), "hot": [0.0 if i % 3 else float(i) for i in range(n)],
        "signs": (rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)).tolist(), "one": [None] * (n - 1) + [7.5],
        "none": [None] * n, "gaps": [None if i % 5 == 0 else float(i % 17) for i in range(n)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    _check(df.repartition(5), cols)


def test_texts_integers_and_empty(spark):
    df = spark.createDataFrame([("1", 3, 2), ("x", 4, 2), ("2.5", None, 2), (None, 2**40, 2)], "s string, `column` long, value int")
    _check(df, {"s": [1.0, 2.5], "column": [3.0, 4.0, 2.0**40], "value": [2.0] * 4})
    _check(df.limit(0), {"s": [], "column": [], "value": []})


def test_medians_of_many_rows(spark):
    df = spark.range(100000).select((F.col("id") % 1000 * 1.5).alias("a"), F.col("id").cast("double").alias("b"))
    got = {r["column"]: r["median"] for r in profile(df, ["a", "b"], {"median": 0.5}).collect()}
    assert got == {"a": 749.25, "b": 49999.5}

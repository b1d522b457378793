"""Hot keys, equal values and zero scores."""

import statistics

from pyspark.sql import functions as F

from pairmill.operators import agg, topk


def test_quantiles_with_mostly_equal_values(spark):
    vals = [0.0] * 1900 + [float(i) for i in range(100)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = agg.exact_quantiles(df, "v", {"p50": 0.5, "p96": 0.96, "p100": 1.0}).first()
    full = statistics.quantiles([v for v in vals if v is not None], n=100, method="inclusive")
    assert abs(got["p50"] - full[49]) < 1e-9 and abs(got["p96"] - full[95]) < 1e-9 and got["p100"] == 99.0
    empty = agg.exact_quantiles(df.filter("v < -1"), "v", {"p50": 0.5}).first()
    assert empty["p50"] is None


def test_topk_hot_key_and_zero_fill(spark, monkeypatch):
    """One key held by all queries and items is dealt into chunks; queries
    without enough shared keys are filled by smallest id."""
    monkeypatch.setattr(topk, "CHUNK", 7)
    nq, ni, k = 40, 60, 5
    q = [(i, "all", 1.0) for i in range(nq)] + [(i, f"k{i % 3}", 2.0) for i in range(nq)]
    it = [(j, "all", 1.0 + j % 4) for j in range(ni)] + [(j, f"k{j % 3}", 0.5) for j in range(0, ni, 2)]
    lone = [(100, "rare", 1.0), (101, "nowhere", 1.0)]
    qdf = spark.createDataFrame(q + lone, "qid long, key string, qw double")
    idf = spark.createDataFrame(it + [(9, "rare", 3.0)], "iid long, key string, iw double")
    allq = spark.createDataFrame([(i,) for i in [*range(nq), 100, 101, 102]], "qid long")
    alli = spark.createDataFrame([(j,) for j in range(ni)], "iid long")
    got = {(r.qid, r["rank"]): (r.iid, r.score) for r in
           topk.topk_sparse_dot(qdf, idf, k, start_depth=5, growth=2, all_queries=allq, all_items=alli).collect()}
    iw = {}
    for j, key, w in it + [(9, "rare", 3.0)]:
        iw.setdefault(j, {})[key] = w
    want = {}
    for i in [*range(nq), 100, 101, 102]:
        mine = [(key, w) for x, key, w in q + lone if x == i]
        s = sorted(((-sum(w * iw[j].get(key, 0.0) for key, w in mine), j) for j in range(ni)))
        for n, (v, j) in enumerate(s[:k], 1):
            want[i, n] = (j, -v)
    assert {a: (b[0], round(b[1], 9)) for a, b in got.items()} == {a: (b[0], round(b[1], 9) + 0.0) for a, b in want.items()}

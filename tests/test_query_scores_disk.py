"""Weights of asked terms: the vocabulary is made once, and shuffle files of earlier steps are let go of."""

import glob
import os

from pairmill import session
from pairmill.operators import tfidf, topk


def test_vocabulary_is_made_once(spark):
    df = spark.createDataFrame([(1, "red blue red green"), (2, "blue green"), (3, "red"), (4, None)], "id long, text string")
    only = spark.createDataFrame([("red",), ("blue green",)], "term string")
    vocab, _ = tfidf.fit_transform(df, "id", "text", min_df=1, max_df=1.0, stop_words=["zz"], only=only)
    assert "Exchange" not in vocab._jdf.queryExecution().executedPlan().toString()
    assert {r.term: r.df for r in vocab.collect()} == {"red": 2, "blue": 2, "green": 2, "red blue": 1, "blue red": 1, "red green": 1, "blue green": 1}


def test_shuffle_files_go_before_the_items_are_ranked(spark, monkeypatch):
    calls = []
    real = topk.collect_garbage
    monkeypatch.setattr(topk, "collect_garbage", lambda s: calls.append(1) or real(s))
    q = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "qid string, key string, qw double")
    it = spark.createDataFrame([(i, "x" if i % 3 else "y", 1.0 + i) for i in range(400)], "iid int, key string, iw double")
    got = {(r.qid, r.iid) for r in topk.topk_sparse_dot(q, it, 2).collect()}
    assert got == {("a", 398), ("a", 397), ("b", 399), ("b", 396)} and len(calls) >= 2


def test_collected_garbage_frees_shuffle_files(spark):
    import time
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(len(glob.glob(os.path.join(d, "*", "shuffle_*.data"))) for d in top)
    spark.range(5000).repartition(7).selectExpr("id % 50 AS k").groupBy("k").count().checkpoint()
    had = count()
    for _ in range(20):
        session.collect_garbage(spark)
        time.sleep(0.5)
        if count() < had:
            break
    assert count() < had

"""Property tests (SURVEY §5 (3)) on small random inputs; few examples each
because every example runs Spark jobs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.functions.vectors import cosine
from pairmill.operators.joins import anti_join, semi_join
from pairmill.operators.metrics import group_ndcg
from pairmill.operators.rank import stratified_split
from pairmill.operators.topk import topk_sparse_dot
from pairmill.sources.io import upsert

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))

rows_st = st.lists(st.tuples(st.integers(0, 3), st.sampled_from([0.1, 0.5, 0.9, 0.3]), st.integers(0, 1)),
                   min_size=1, max_size=40)


@SETTINGS
@given(rows=rows_st)
def test_ndcg_in_unit_interval(spark, rows):
    df = spark.createDataFrame([(f"g{g}", i, s, t) for i, (g, s, t) in enumerate(rows)], "g string, id int, s double, t int")
    for r in group_ndcg(df, "g", "s", "t", "id").collect():
        assert 0.0 <= r.ndcg <= 1.0 + 1e-12 and r.n >= 2


@SETTINGS
@given(labels=st.lists(st.integers(0, 2), min_size=1, max_size=60), frac=st.sampled_from([0.2, 0.3, 0.5]))
def test_split_sizes_exact_per_class(spark, labels, frac):
    df = spark.createDataFrame(list(enumerate(labels)), "id int, y int")
    got = {(r.y, r.split): r.n for r in stratified_split(df, "y", "id", frac, "1")
           .groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    for y in set(labels):
        n = labels.count(y)
        assert got.get((y, "test"), 0) == math.ceil(n * frac)
        assert got.get((y, "test"), 0) + got.get((y, "train"), 0) == n


@SETTINGS
@given(old=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=12),
       new=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=12))
def test_upsert_idempotent_and_keyed(spark, old, new):
    o = spark.createDataFrame([(str(k), v) for k, v in old], "id string, v int").dropDuplicates(["id"])
    n = spark.createDataFrame([(str(k), v) for k, v in new], "id string, v int").dropDuplicates(["id"])
    once = upsert(o, n, ["id"])
    twice = upsert(once, n, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.select("id").distinct().count() == once.count()


@SETTINGS
@given(a=st.lists(st.integers(0, 20), max_size=25), b=st.lists(st.integers(0, 20), max_size=25))
def test_anti_plus_semi_is_all(spark, a, b):
    da = spark.createDataFrame([(x,) for x in a], "k int")
    db = spark.createDataFrame([(x,) for x in b], "k int")
    assert anti_join(da, db, "k").count() + semi_join(da, db, "k").count() == len(a)


@SETTINGS
@given(v=st.lists(st.floats(-5, 5, allow_nan=False), min_size=3, max_size=3),
       w=st.lists(st.floats(-5, 5, allow_nan=False), min_size=3, max_size=3))
def test_cosine_symmetric_and_bounded(spark, v, w):
    r = spark.createDataFrame([(v, w)], "a array<double>, b array<double>").select(
        cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("b"), F.col("a")).alias("y")).first()
    assert abs(r.x - r.y) < 1e-12 and -1 - 1e-9 <= r.x <= 1 + 1e-9


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(q=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4)), min_size=1, max_size=15),
       it=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 4), st.sampled_from([0.25, 0.5, 1.0])),
                   min_size=1, max_size=60),
       k=st.integers(1, 4))
def test_topk_equals_brute_force(spark, q, it, k):
    qdf = spark.createDataFrame([(f"q{a}", f"k{b}", 1.0) for a, b in q], "qid string, key string, qw double")
    idf = spark.createDataFrame([(f"i{a:02d}", f"k{b}", w) for a, b, w in it], "iid string, key string, iw double")
    got = {(r.qid, r.rank): (r.iid, round(r.score, 6)) for r in
           topk_sparse_dot(qdf, idf, k, start_depth=1, growth=2).collect()}
    qq = qdf.groupBy("qid", "key").agg(F.sum("qw").alias("qw"))
    ii = idf.groupBy("iid", "key").agg(F.sum("iw").alias("iw"))
    s = qq.join(ii, "key").groupBy("qid", "iid").agg(F.round(F.sum(F.col("qw") * F.col("iw")), 9).alias("s"))
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "iid")
    ref = {(r.qid, r.rk): (r.iid, round(r.s, 6)) for r in
           s.filter("s > 0").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).collect()}
    assert got == ref

"""Ranking, sampling, joins and the exact top-k operator against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.operators.indexing import dense_index, group_positions
from pairmill.operators.joins import contained_terms, negative_pairs
from pairmill.operators.metrics import group_ndcg
from pairmill.operators.rank import latest_per_key, stratified_split
from pairmill.operators.topk import topk_sparse_dot


def test_latest_ties(spark):
    rows = [("a", 2, 1), ("a", 2, 2), ("a", 1, 3), ("b", 5, 4), ("b", 3, 5)]
    df = spark.createDataFrame(rows, "id string, t int, e int")
    one = {r.id: r.e for r in latest_per_key(df, ["id"], "t", "one", ["e"]).collect()}
    assert one == {"a": 2, "b": 4}
    drop = {r.id: r.e for r in latest_per_key(df, ["id"], "t", "drop", ["e"]).collect()}
    assert drop == {"b": 4}  # X10: the tied newest rows of 'a' vanish


def test_dense_index_and_group_positions(spark):
    rows = [(f"k{i % 3 if i % 5 else 0}", random.Random(i).random(), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(7)
    idx = sorted(r.idx for r in dense_index(df, [F.col("v"), F.col("id")]).collect())
    assert idx == list(range(300))
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    ref = {r.id: r.rn - 1 for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    for chunk in (1 << 20, 7):  # 7: every group spans several salt chunks
        gp = {(r.id): r.pos for r in group_positions(df, ["k"], [F.desc("v"), F.col("id")], chunk=chunk).collect()}
        assert gp == ref


def test_stratified_split_exact(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(101)], "id int, y int")
    s = stratified_split(df, "y", "id", 0.2, "42")
    c = {(r.y, r.split): r.n for r in s.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert c[(1, "test")] == 6 and c[(1, "train")] == 20 and c[(0, "test")] == 15 and c[(0, "train")] == 60


def test_negative_pairs_exclude_matches(spark):
    left = spark.createDataFrame([(str(i),) for i in range(20)], "v string")
    right = spark.createDataFrame([(str(i),) for i in range(50)], "r string")
    m = spark.createDataFrame([(str(i), str(j)) for i in range(20) for j in range(i, i + 30)], "v string, r string")
    neg = negative_pairs(left, right, m, 12, "v", "r", "7")
    rows = neg.collect()
    assert len(rows) == 20 * 12
    assert not set((r.v, r.r) for r in rows) & set((r.v, r.r) for r in m.collect())
    assert neg.select("v", "r").distinct().count() == len(rows)


def test_contained_terms_exact(spark):
    docs = spark.createDataFrame([("1", "Supplier#000000001 Brand#22 AUTOMOBILE"), ("2", "x")], "id string, t string")
    terms = spark.createDataFrame([("Brand#2",), ("Brand#22",), ("000000001",), ("AUTOMOBILE x",),
                                   ("Supplier#000000001 Brand",)], "term string")
    got = sorted((r.id, r.term) for r in contained_terms(docs, terms, "id", "t", "term", prefix=4).collect())
    assert got == [("1", "000000001"), ("1", "Brand#2"), ("1", "Brand#22"), ("1", "Supplier#000000001 Brand")]


def test_topk_matches_brute_force_with_hot_key_and_ties(spark):
    rnd = random.Random(3)
    q = [(f"q{i}", f"k{rnd.randrange(6)}", 1.0) for i in range(25) for _ in range(3)]
    # key k0 is hot (in most items), many ties
    it = [(f"i{j:03d}", "k0", 1.0) for j in range(150)] + \
         [(f"i{rnd.randrange(150):03d}", f"k{rnd.randrange(1, 6)}", rnd.choice([0.5, 1.0, 2.0])) for _ in range(200)]
    qdf = spark.createDataFrame(q, "qid string, key string, qw double")
    idf = spark.createDataFrame(it, "iid string, key string, iw double")
    got = {(r.qid, r.rank): (r.iid, round(r.score, 6)) for r in
           topk_sparse_dot(qdf, idf, 5, start_depth=5, growth=2).collect()}
    qq = qdf.groupBy("qid", "key").agg(F.sum("qw").alias("qw"))
    ii = idf.groupBy("iid", "key").agg(F.sum("iw").alias("iw"))
    s = qq.join(ii, "key").groupBy("qid", "iid").agg(F.round(F.sum(F.col("qw") * F.col("iw")), 9).alias("s"))
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "iid")
    ref = {(r.qid, r.rk): (r.iid, round(r.s, 6)) for r in
           s.withColumn("rk", F.row_number().over(w)).filter("rk <= 5").collect()}
    assert got == ref


def test_ndcg_tie_average_and_empty_group(spark):
    rows = [("g", 1, 0.9, 1), ("g", 2, 0.9, 0), ("g", 3, 0.1, 1), ("h", 4, 0.5, 0), ("h", 5, 0.4, 0), ("s", 6, 0.3, 1)]
    df = spark.createDataFrame(rows, "g string, id int, s double, t int")
    out = {r.g: r.ndcg for r in group_ndcg(df, "g", "s", "t", "id").collect()}
    import math
    d = [1 / math.log2(i + 2) for i in range(3)]
    dcg = (d[0] + d[1]) / 2 * 1 + d[2]
    assert abs(out["g"] - dcg / (d[0] + d[1])) < 1e-12
    assert out["h"] == 0.0 and "s" not in out  # no positives → 0; one-row group skipped


def test_replace_values_and_validation(spark):
    from pairmill.operators.clean import replace_values, validate
    df = spark.createDataFrame([("NDT", 1), ("Активно ищет работу", 2), ("x", 0)], "s string, t int")
    out = replace_values(df, {"NDT": "Рассматривает предложения", "x": "Рассматривает предложения"}, ["s"])
    assert [r.s for r in out.collect()] == ["Рассматривает предложения", "Активно ищет работу",
                                            "Рассматривает предложения"]
    ok, bad = validate(df, {"target_in_01": F.col("t").isin(0, 1)})
    assert ok.count() == 2 and bad.first()["reasons"] == ["target_in_01"]

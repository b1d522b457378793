"""Work that repeated rows must not multiply: items of equal entries are ranked once, a fit keeps no
counts on disk, ALS cuts its lineage at each step, short rows with long pages are dealt by their number."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pairmill.operators import als, tfidf, topk
from pairmill.plans import q_pages


def test_items_of_equal_entries_are_ranked_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "RARE", 3)
    draw = random.Random(5)
    items = [(i, key, w) for i in range(300) for key, w in [(f"c{i % 4}", 1.0), (f"d{i % 3}", 0.5)] + ([(f"u{i // 2}", 0.25)] if i < 20 else [])]
    queries = [(q, f"c{q % 4}", 1.0) for q in range(40)] + [(q, f"d{q % 3}", 1.0) for q in range(0, 40, 2)] + [(q, f"u{q % 10}", 2.0) for q in range(0, 40, 5)]
    draw.shuffle(items)
    seen = []
    lists = topk._topk_lists

    def counted(q, it, *rest):
        seen.append((q.select("qid").distinct().count(), it.select("iid").distinct().count()))
        return lists(q, it, *rest)
    monkeypatch.setattr(topk, "_topk_lists", counted)
    everyone, all_items = spark.range(42).toDF("qid"), spark.range(305).toDF("iid")
    got = topk.topk_sparse_dot(spark.createDataFrame(queries, "qid long, key string, qw double"), spark.createDataFrame(items, "iid long, key string, iw double"),
                               5, all_queries=everyone, all_items=all_items).collect()
    w = defaultdict(dict)
    for i, key, x in items:
        w[i][key] = x
    for q in range(42):
        score = {i: round(sum(x * w[i].get(key, 0.0) for a, key, x in queries if a == q), 9) for i in range(305)}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        mine = sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])
        assert [(r.iid, r.score) for r in mine] == [(i, score[i]) for i in want], q
    assert seen == [(16, 12)] or (seen[0][0] <= 16 and seen[0][1] <= 12)


def test_fit_keeps_no_counts_on_disk(spark, monkeypatch):
    texts = ["alpha beta alpha beta gamma", "beta gamma", None, "", "gamma gamma gamma", "beta gamma"]
    kept = []
    monkeypatch.setattr(tfidf, "checkpoint", lambda df: kept.append(df.columns) or df)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.term: (r.df, r.tf) for r in tfidf.fit(df, "text", min_df=1, max_df=1.0, stop_words=["zz"]).collect()}
    docs = [t.split() for t in {t for t in texts if t}]
    grams = [Counter(d + [f"{a} {b}" for a, b in zip(d, d[1:])]) for d in docs]
    assert got == {t: (sum(t in g for g in grams), sum(g[t] for g in grams)) for t in set().union(*grams)}
    assert kept == []


def test_weights_of_some_terms_equal_those_of_all(spark):
    df = spark.createDataFrame([(1, "red blue red green"), (2, "blue green"), (3, "red"), (4, None), (5, "blue green")], "id long, text string")
    only = spark.createDataFrame([("red",), ("blue green",), ("none",)], "term string")
    _, everything = tfidf.fit_transform(df, "id", "text", min_df=1, max_df=1.0, stop_words=["zz"])
    _, some = tfidf.fit_transform(df, "id", "text", min_df=1, max_df=1.0, stop_words=["zz"], only=only)
    rows = lambda x: sorted((r.id, r.term, round(r.w, 9)) for r in x.collect())
    assert rows(some) == [r for r in rows(everything) if r[1] in ("red", "blue green")]


def test_als_cuts_its_lineage_at_each_step(spark, monkeypatch):
    asked = {}
    real = als.ALS
    monkeypatch.setattr(als, "ALS", lambda **params: asked.update(params) or real(**params))
    pairs = spark.createDataFrame([(f"u{i % 6}", f"i{i % 5}") for i in range(40)], "u string, i string")
    rows, ui, ii = als.interaction_rows(pairs, "u", "i")
    als.fit_als(rows, rank=2, max_iter=2)
    assert asked["checkpointInterval"] == 1


def test_profile_pages_are_dealt_by_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_pages, "PAGES_A_TASK", 10)
    c = spark.range(200).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(0).cast("long").alias("c_nationkey"),
                                F.lit("S").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))
    c.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "N")], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    pages = q_pages.profile_pages(spark, str(tmp_path))
    assert pages.select(F.spark_partition_id().alias("p")).distinct().count() >= 15
    assert pages.count() == 200


def test_float_vectors_stay_floats(spark, monkeypatch):
    from pairmill.operators import inner_product
    kinds = []
    blocked = inner_product._blocked
    monkeypatch.setattr(inner_product, "_blocked", lambda rows: kinds.append(rows.schema["vec"].dataType.elementType.simpleString()) or blocked(rows))
    rows = [(i, [((i * 5 + j * 7) % 13 - 6) / 3 for j in range(4)]) for i in range(30)]
    f, d = (spark.createDataFrame(rows, f"id long, embedding array<{t}>") for t in ("float", "double"))
    got = inner_product.inner_product_topk(
        f.withColumnRenamed("id", "qid"), f.withColumnRenamed("id", "iid"), 3).collect()
    exact = dict(f.select("id", F.col("embedding").cast("array<double>")).collect())
    for q in range(30):
        score = {i: round(sum(a * b for a, b in zip(exact[q], exact[i])), 9) for i in range(30)}
        want = sorted(score, key=lambda i: (-score[i], i))[:3]
        assert [r.iid for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == want
    assert kinds == ["float", "float"]
    inner_product.inner_product_topk(d.withColumnRenamed("id", "qid"), d.withColumnRenamed("id", "iid"), 3).collect()
    assert kinds[2:] == ["double", "double"]

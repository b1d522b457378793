"""ALS and the split before it: rows are written narrow, and blocks do not grow with the ratings."""

from pyspark.sql import functions as F

from pairmill.operators import als, indexing, rank


def test_blocks_hold_a_bounded_number_of_ratings(spark, monkeypatch):
    assert als.als_blocks(36_000_000, 6) == 6 and als.als_blocks(216_000_000, 6) == 36 and als.als_blocks(0, 4) == 4
    asked, real = {}, als.ALS
    monkeypatch.setattr(als, "ALS", lambda **params: asked.update(params) or real(**params))
    monkeypatch.setattr(als, "BLOCK_RATINGS", 5)
    pairs = spark.createDataFrame([(f"u{i % 6}", f"i{i % 7}") for i in range(42)], "u string, i string")
    als.fit_als(als.interaction_rows(pairs, "u", "i")[0], rank=2, max_iter=1)
    assert asked["numUserBlocks"] == asked["numItemBlocks"] == 9


def test_split_writes_no_sort_key_and_shuffles_once(spark, monkeypatch):
    written, real = [], indexing.checkpoint
    monkeypatch.setattr(indexing, "checkpoint", lambda df, **k: written.append(df.columns) or real(df, **k))
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("y"))
    s = rank.stratified_split(df, "y", "id", 0.2, "1")
    assert written[0][:2] == ["id", "y"] and "__h" not in written[0]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    # as many test rows a class as before, in the order of the hashes as text
    want = {}
    for r in df.select("id", "y", indexing.hash_key("1", "id").alias("h")).collect():
        want.setdefault(r.y, []).append((r.h, r.id))
    test = {i for rows in want.values() for _, i in sorted(rows)[:20]}
    assert {r.id for r in s.collect() if r.split == "test"} == test
    monkeypatch.setattr(indexing, "FEW_STARTS", 0)
    assert {r.id for r in rank.stratified_split(df, "y", "id", 0.2, "1").collect() if r.split == "test"} == test


def test_only_positive_rows_are_split_for_the_inner_fit(spark, monkeypatch):
    seen, real = [], rank.stratified_split
    monkeypatch.setattr(rank, "stratified_split", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    rows = spark.createDataFrame([(f"u{i % 5}", f"i{i % 8}", i % 2) for i in range(40)], "u string, i string, y int")
    als.leak_free_scores(rows.filter("i <> 'i7'"), rows.filter("i = 'i7'"), "u", "i", "y", rank=2, max_iter=1).count()
    assert {r.y for r in seen[0].collect()} == {1}

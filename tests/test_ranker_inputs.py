"""What a ranker is fed: no label reaches its own row, unknown values are -1, reasons in one pass."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pairmill.operators.als import leak_free_scores
from pairmill.operators.clean import tag_reasons, validate
from pairmill.operators.models import ordinal_encoder
from pairmill.operators.rank import stratified_split


def _scores(df, part):
    return {(r.u, r.i): round(r.als_score, 3) for r in df.filter(F.col("part") == part).collect()}


def test_held_out_labels_do_not_reach_scores(spark):
    rows = [(f"u{a}", f"i{b}", int((a + b) % 3 == 0 or a % 5 == b % 5)) for a in range(12) for b in range(12) if (a * b) % 4 != 3]
    train = spark.createDataFrame(rows, "u string, i string, y int")
    test = spark.createDataFrame([("u1", "i1", 1), ("u2", "new", 0)], "u string, i string, y int")
    first = leak_free_scores(train, test, "u", "i", "y", rank=4, max_iter=4)
    assert first.filter(F.col("part") == "train").count() == len(rows)
    # rows that the inner split holds out are dropped from the fit: the scores of all train rows stay as they are
    held = {(r.u, r.i) for r in stratified_split(train.withColumn("k", F.concat_ws("|", "u", "i")), "y", "k", 0.3, "7")
            .filter(F.col("split") == "test").collect()}
    assert 0 < len(held) < len(rows)
    from pairmill.operators import als
    kept = spark.createDataFrame([r for r in rows if r[:2] not in held and r[2] > 0], "u string, i string, y int")
    x, ui, ii = als.interaction_rows(kept, "u", "i")
    uf, itf = als.factor_tables(als.fit_als(x, rank=4, max_iter=4), ui, ii, "u", "i")
    want = {(r.u, r.i): round(r.als_score, 3) for r in als.pair_scores(train, uf, itf, "u", "i").collect()}
    got = _scores(first, "train")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.002 for k in got)
    # the label of a test row plays no part, and an unknown one scores 0
    flipped = leak_free_scores(train, test.withColumn("y", 1 - F.col("y")), "u", "i", "y", rank=4, max_iter=4)
    a, b = _scores(first, "test"), _scores(flipped, "test")
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 0.002 for k in a) and a[("u2", "new")] == 0.0


def test_unknown_and_null_are_minus_one(spark, tmp_path):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None)], "c string, `d e` string")
    m = ordinal_encoder(train, ["c", "d e"])
    m.write().save(str(tmp_path / "m"))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "z", "x"), (4, None, None)], "id int, c string, `d e` string")
    got = PipelineModel.load(str(tmp_path / "m")).transform(rows)
    assert {r.id: (r["c__ord"], r["d e__ord"]) for r in got.collect()} == {1: (0.0, 0.0), 2: (1.0, -1.0), 3: (-1.0, 0.0), 4: (-1.0, -1.0)}
    assert got.columns[:3] == ["id", "c", "d e"]


def test_reasons(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, None, 5), (3, "", None)], "id int, s string, t int")
    rules = {"blank": F.trim("s") != "", "range": F.col("t").isin(0, 1)}
    assert {r.id: r.reasons for r in tag_reasons(df, rules).collect()} == {1: [], 2: ["blank", "range"], 3: ["blank", "range"]}
    ok, bad = validate(df, rules)
    assert [r.id for r in ok.collect()] == [1] and {r.id for r in bad.collect()} == {2, 3}

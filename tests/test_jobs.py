"""Job compositions and sources: batch features, model save/load and
ranking, retraining artefacts, CSV and normalisation helpers."""

import os
import tempfile

from pyspark.sql import functions as F

from pairmill.operators import models
from pairmill.plans.jobs import FEATURES, batch_features, rank_pairs, retrain
from pairmill.sources.io import export_top, normalize_rows, read_csv, upsert

SF = "/root/testdata/sf0.001"


def test_batch_features_contract(spark):
    rows = [(1, "Москва", "Москва", "Python SQL аналитика данных", "Python, SQL", "Аналитик данных",
             "аналитика данных на Python", 1990, "2 года 3 месяца"),
            (2, "Казань", "Москва", "Java", "['Go']", "Backend", "", None, None)]
    df = spark.createDataFrame(rows, "row_id int, vacancy_area string, resume_location string, vacancy_description string, "
                                     "resume_skills string, resume_last_position string, "
                                     "resume_last_experience_description string, resume_age int, "
                                     "resume_last_company_experience_period string")
    out = batch_features(df)
    assert out.columns == ["row_id"] + FEATURES
    r = {x.row_id: x for x in out.collect()}
    assert r[1].location_matching == 1.0 and r[1].resume_skill_count_in_vacancy == 2.0
    assert r[1].resume_age == 36.0 and r[1].resume_last_company_experience_months == 27.0
    assert r[1].similarity_score_tfidf > 0 and r[2].similarity_score_tfidf == 0.0
    assert r[2].resume_age == 30.0 and r[2].vacancy_experience == "NDT"


def test_model_save_load_rank_and_retrain(spark):
    base = tempfile.mkdtemp(prefix="jobs-")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    d = docs.select(F.col("source").alias("vacancy_id"), F.col("doc_id").cast("string").alias("resume_id"),
                    "lang", "n_chars", F.col("quality").alias("target"))
    m = models.fit_pipeline(d, ["lang"], ["n_chars"], "lr")
    p = models.save_model(m, os.path.join(base, "m"))
    top = rank_pairs(d, models.load_model(p), k=3)
    assert top.groupBy("vacancy_id").count().agg(F.max("count")).first()[0] <= 3
    paths = retrain(d, ["lang"], ["n_chars"], os.path.join(base, "r"), kind="lr",
                    als_params={"rank": 4, "max_iter": 3})
    assert spark.read.parquet(paths["user_factors"]).count() > 0
    assert models.load_model(paths["model"]).transform(
        d.withColumn("als_score", F.lit(0.0))).count() == d.count()


def test_csv_normalise_upsert(spark):
    base = tempfile.mkdtemp(prefix="io-")
    df = spark.createDataFrame([("a", 1.0, "x,\ny"), ("b", 3.0, None)], "id string, s double, t string")
    export_top(df, "s", os.path.join(base, "top"), n=1, id_col="id")
    back = read_csv(spark, os.path.join(base, "top"), "id string, s double, t string").collect()
    assert [tuple(r) for r in back] == [("b", 3.0, None)]
    n = normalize_rows(df, strings=["t", "u"], numbers=["s"], source="web").collect()
    assert n[1].t == "" and n[1].u == "" and n[0].source == "web"
    old = spark.createDataFrame([("1", "a", 1), ("2", "a", 2)], "id string, src string, v int")
    new = spark.createDataFrame([("2", "a", 20), ("3", "a", 30)], "id string, src string, v int")
    got = sorted(tuple(r) for r in upsert(old, new, ["id", "src"]).collect())
    assert got == [("1", "a", 1), ("2", "a", 20), ("3", "a", 30)]
    again = sorted(tuple(r) for r in upsert(upsert(old, new, ["id", "src"]), new, ["id", "src"]).collect())
    assert again == got  # idempotent

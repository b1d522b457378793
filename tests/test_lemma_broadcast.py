"""Lemmas are looked up in a text's own row: only the texts and the terms of the vocabulary are shuffled."""

import collections
import random

import pyarrow as pa
from pyspark.sql import functions as F

from pairmill.operators import tfidf


def _words(spark):
    rng = random.Random(4)
    forms = ["work", "works", "working", "data", "table", "tables", "stone"]
    texts = [" ".join(rng.choices(forms, k=rng.randrange(1, 30))) for _ in range(40)] + ["works works"] * 3 + ["", None]
    lemmas = spark.createDataFrame([("works", "work"), ("working", "work"), ("tables", "table"), ("work", "table")], "form string, lemma string")
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), lemmas


def test_fit_shuffles_texts_and_terms_alone(spark):
    df, lemmas = _words(spark)
    v = tfidf.fit(df, "text", min_df=1, max_df=1.0, lemmas=lemmas, stop_words=[])
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan, plan


def test_large_and_small_lemma_tables_give_the_same(spark, monkeypatch):
    df, lemmas = _words(spark)
    fit = lambda: {(r.term, r.df, r.tf) for r in tfidf.fit(df, "text", min_df=1, max_df=1.0, lemmas=lemmas, stop_words=[]).collect()}
    small = fit()
    monkeypatch.setattr(tfidf, "LEMMA_FORMS", 0)
    assert fit() == small and {t for t, *_ in small} >= {"work", "table table"}


def test_words_are_translated_once(spark):
    rows = spark.createDataFrame([(1, ["works", "work", "x"]), (2, ["x"]), (3, ["working", "work"])], "id int, w array<string>")
    table = pa.table({"form": ["works", "work"], "lemma": ["work", "y"]})
    got = {r.id: list(r.w) for r in tfidf.translate_words(rows.repartition(2), table).collect()}
    assert got == {1: ["work", "y", "x"], 2: ["x"], 3: ["working", "y"]}
    empty = table.slice(0, 0)
    assert {r.id: list(r.w) for r in tfidf.translate_words(rows, empty).collect()} == {1: ["works", "work", "x"], 2: ["x"], 3: ["working", "work"]}


def test_copies_of_a_text_count_once(spark):
    df, _ = _words(spark)
    counts, n = tfidf.text_counts(df, "text", stop_words=[])
    texts = {r.text for r in df.collect() if r.text is not None}
    assert n == len(texts)
    got = collections.Counter(r["__h"] for r in counts.filter(~F.col("term").contains(" ")).collect())
    assert len(got) == len({t for t in texts if t})

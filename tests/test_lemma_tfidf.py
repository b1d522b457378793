"""Lemmas in TF-IDF: equal to lemmatising the token sequence, for any tokenizer and lemma table."""

import collections
import random

from pyspark.sql import functions as F

from pairmill.functions.tokens import lemmatize, suffix_lemmas
from pairmill.operators import tfidf


def _texts(spark):
    rng = random.Random(9)
    forms = ["work", "works", "working", "data", "table", "tables", "join", "joined", "stone"]
    texts = [" ".join(rng.choices(forms, k=rng.randrange(1, 40))) for _ in range(60)] + ["", None, "works works", "works works"]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


LEMMAS = [("works", "work"), ("working", "work"), ("tables", "table"), ("joined", "join"), ("joined", "zz"),
          (None, "x"), ("data", None), ("stone", "stone"), ("unseen", "never")]


def test_counts_equal_the_lemma_sequence(spark):
    texts, df = _texts(spark)
    lem = {"works": "work", "working": "work", "tables": "table", "joined": "join"}
    want = {}
    for t in {t for t in texts if t is not None}:
        ws = [lem.get(w, w) for w in t.split()]
        for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
            want.setdefault(t, collections.Counter())[g] += 1
    table = spark.createDataFrame(LEMMAS, "form string, lemma string")
    counts, n = tfidf.text_counts(df, "text", lemmas=table, stop_words=[])
    keys = {r.h: r.text for r in df.select("text", F.md5("text").alias("h")).collect()}
    got = collections.defaultdict(collections.Counter)
    for r in counts.collect():
        got[keys[r["__h"]]][r.term] += r.c
    assert dict(got) == want and n == len({t for t in texts if t is not None})


def test_weights_equal_lemmatised_texts(spark):
    _, df = _texts(spark)
    table = spark.createDataFrame([x for x in LEMMAS if x[0] and x[1] and x[1] != "zz"], "form string, lemma string")
    _, w = tfidf.fit_transform(df, "id", "text", min_df=1, max_df=1.0, lemmas=table, stop_words=[])
    toks = df.filter(F.col("text").isNotNull()).select("id", F.filter(F.split("text", " "), lambda x: x != "").alias("t"))
    plain = lemmatize(toks, "id", "t", table).select("id", F.concat_ws(" ", "lemmas").alias("text"))
    # the plain way counts distinct lemmatised texts, so weigh by the same counts of texts
    counts, _ = tfidf.text_counts(plain, "text", stop_words=[])
    of = {(r.id, r.term): r.c for r in plain.select("id", F.md5("text").alias("__h")).join(counts, "__h").collect()}
    assert {(r.id, r.term) for r in w.collect()} == set(of)
    assert all(abs(r.n - 1) < 1e-9 for r in w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())


def test_tokenizer_is_exchangeable(spark):
    df = spark.createDataFrame([(1, "A-1 b2"), (2, "b2 c3")], "id int, text string")
    v = tfidf.fit(df, "text", min_df=1, max_df=1.0, stop_words=[], tokenizer=lambda c: F.split(F.lower(c), " "))
    assert {r.term: r.df for r in v.collect()} == {"a-1": 1, "b2": 2, "c3": 1, "a-1 b2": 1, "b2 c3": 1}


def test_suffix_lemmas(spark):
    forms = spark.createDataFrame([(w,) for w in ["work", "works", "working", "workings", "sing", "s", "house", "houses", None, "work", "bring"]], "form string")
    got = {r.form: r.lemma for r in suffix_lemmas(forms, ("s", "es", "ing", "ings")).collect()}
    assert got == {"works": "work", "working": "work", "workings": "work", "houses": "house"}
    assert suffix_lemmas(forms.limit(0), ("s",)).collect() == []

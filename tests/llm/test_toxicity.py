import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm import toxicity as tox
from pairmill.llm.common import BATCH_CONF, remainder
from pairmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _texts(n, seed=0):
    r = random.Random(seed)
    clean = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["grimble", "snorfed", "xarky"]
    out = []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(1, 80))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(bad).upper()
        out.append((i, " ".join(words), "en" if i % 2 else None, int(i % 3 == 0)))
    return out


def _frames(spark, rows):
    docs = spark.createDataFrame([(i, t, x, "clash", 0.5) for i, t, x, _ in rows], "doc_id long, text string, lang string, score string, rejected double")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    return docs, labels


def test_learns_on_unseen_rows_and_whole_texts(spark):
    rows = _texts(900)
    docs, labels = _frames(spark, rows)
    model = tox.learn(docs, labels, allowed=lambda i: remainder(i, 4) != 2)
    more = [(5000, "aaaaa " * 30000 + " grimble", "en", 1), (5001, None, None, 0), (5002, "", "xx", 0), (5003, "?!", "en", 0)]
    docs, _ = _frames(spark, rows + more + rows[:1])
    got = tox.score(docs, model).collect()
    assert len(got) == len(rows) + 5
    by = {r["doc_id"]: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = np.mean([(by[i]["score"] >= 0.3) == bool(y) for i, _, _, y in held])
    assert len(held) > 100 and right > 0.97
    assert by[5000]["score"] > 0.3 and by[5000]["rejected"]
    assert by[5001]["score"] == by[5002]["score"] == by[5003]["score"] < 0.3
    assert all(0 <= r["score"] <= 1 for r in got)


def test_score_is_of_the_text_alone(spark):
    rows = _texts(300, 1)
    model = tox.learn(*_frames(spark, rows))
    one = np.concatenate([model.score([t]) for _, t, _, _ in rows[:40]])
    assert np.allclose(one, model.score([t for _, t, _, _ in rows[:40]]), atol=1e-6)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 1)], [(1, 0), (1, 1)]])
def test_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "en"), (None, "c", None)], "doc_id long, text string, lang string")
    model = tox.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = tox.score(docs, model).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    assert tox.score(docs.limit(0), model).count() == 0


def test_query_never_learns_from_held_out_rows(spark):
    got = QUERIES["op5_toxicity"](spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in got} == docs
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    changed = labels.withColumn("toxic", F.when(remainder(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    free = lambda i: remainder(i, 4) != 2
    a, b = tox.learn(d, labels, free), tox.learn(d, changed, free)
    assert np.array_equal(a.rows, b.rows) and a.scale == b.scale


def test_whole_runs_are_read():
    """Runs that agree in their first bytes and differ later are different words; nothing of a long run is left out."""
    run = ("漢字" * 30).encode()
    for word in (run, b"x" * 100, ("я" * 33).encode(), ("a" + "漢" * 20).encode()):
        assert b"".join(tox._pieces([word])) == word and all(p.decode() and len(p) <= tox.WORD_WIDTH for p in tox._pieces([word]))
    a, b = ("漢字" * 8 + end for end in ("可愛", "毒物"))
    words, ids, starts = tox.encode([a, b, None, ""])
    mark = tox.features(words)
    first, second = (mark[[i for i in ids[s:e] if i >= 0]] for s, e in ((0, starts[1]), (starts[1], starts[2])))
    assert (first[:-1] == second[:-1]).all() and (first[-1] != second[-1]).any()


def test_every_labelled_row_is_read(spark, monkeypatch):
    """More rows than any sample held, and texts of any length: each trains the model or sets its thresholds."""
    rows = [(i, "word " * (10_000 if i == 5 else 1) + str(i), "en", i % 2) for i in range(10_000)]
    docs, labels = _frames(spark, rows)
    read = []
    monkeypatch.setattr(tox, "train", lambda part, counts, slices: read.extend(r[0] for r in part.select("_body").collect()) or tox.constant(0.5))
    monkeypatch.setattr(tox, "calibrate", lambda model, part, share: read.extend(r[0] for r in part.select("_body").collect()))
    tox.learn(docs, labels)
    assert sorted(read) == sorted(t for _, t, _, _ in rows)


def test_copies_are_averaged(spark, monkeypatch):
    """Many tasks, several averagings in a pass: the mean of the copies knows what each saw."""
    monkeypatch.setattr(tox, "SHARD", 100)
    monkeypatch.setattr(tox, "FILE_ROWS", 20)
    monkeypatch.setattr(tox, "STEPS", 1500)
    rows = _texts(900, 5)
    docs, labels = _frames(spark, rows)
    model = tox.learn(docs, labels, allowed=lambda i: remainder(i, 4) != 2)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean((model.score([t for _, t, _, _ in held]) >= 0.3) == [bool(y) for _, _, _, y in held]) > 0.95


def test_parameters_travel_whole():
    a = tox.Learner(tox.blank(np.random.default_rng(1)), np.zeros(tox.ROWS, bool))
    a.touched[[3, 4096, tox.ROWS - 1]] = True
    a.model.offset, a.offset[0] = 2.5, 2.5
    b = tox.Learner(tox.blank(np.random.default_rng(2)), np.zeros(tox.ROWS, bool))
    b.take(*tox._sums(tox.pa.Table.from_batches([tox._blocks(*a.parameters())]), tox.COLUMNS)[:2])
    assert np.array_equal(a.model.rows[a.touched], b.model.rows[a.touched]) and b.model.offset == 2.5
    assert all(np.allclose(x, y) for x, y in zip([*a._values(), *a.sums], [*b._values(), *b.sums]))


def test_unlabelled_texts_stay_out_of_the_join(spark, monkeypatch):
    """All labelled texts come to the join and hardly any other, also with a bitmap that is too small for all."""
    rows = spark.range(3000).select(F.col("id").alias("_id"), F.xxhash64("id").alias("_text"), F.col("id").cast("string").alias("_body"))
    known = rows.where("_id % 3 = 0").select("_id", "_text")
    ids = {r["_id"] for r in tox.likely(rows, known, 1000).collect()}
    assert ids >= set(range(0, 3000, 3)) and len(ids) < 1100
    monkeypatch.setattr(tox, "BITS_MAX", tox.BITS_ROW)
    monkeypatch.setattr(tox, "BITS", 1)
    assert {r["_id"] for r in tox.likely(rows, known, 1000).collect()} >= set(range(0, 3000, 3))
    assert tox.likely(rows, known.limit(0), 0).count() == 0


def test_copies_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tox, "SHARD", 10)
    monkeypatch.setattr(tox, "FILE_ROWS", 10)
    monkeypatch.setattr(tox, "COPIES", 3)
    tasks, moved = [], tox._moved
    monkeypatch.setattr(tox, "_moved", lambda part, *more: tasks.append(part.rdd.getNumPartitions()) or moved(part, *more))
    monkeypatch.setattr(tox, "PASSES", (1, 1))
    tox.learn(*_frames(spark, _texts(600, 3)))
    assert tasks and max(tasks) == 3


def test_model_is_the_same_however_rows_are_sent(spark, monkeypatch):
    monkeypatch.setattr(tox, "PASSES", (1, 1))
    docs, labels = _frames(spark, _texts(1700, 4))
    before, models = spark.conf.get(BATCH_CONF), []
    try:
        for rows in (1000, 170):
            spark.conf.set(BATCH_CONF, str(rows))
            models.append(tox.learn(docs, labels))
    finally:
        spark.conf.set(BATCH_CONF, before)
    a, b = models
    assert np.array_equal(a.rows, b.rows) and a.scale == b.scale and a.thresholds == b.thresholds


def test_regrouped_keeps_rows_and_order():
    sent = [tox.pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 0), (0, 7), (7, 8), (8, 31), (31, 31), (31, 40))]
    got = [b.column(0).to_pylist() for b in tox.regrouped(sent, 10)]
    assert list(map(len, got)) == [10] * 4 and sum(got, []) == list(range(40))
    assert [b.num_rows for b in tox.regrouped(sent[:3], 10)] == [8] and not list(tox.regrouped([], 10))

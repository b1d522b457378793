"""Periodic runs against a scan of all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pairmill.llm import periodic_runs
from pairmill.llm.queries import op12_periodic_runs, with_planted_runs

SF = "/root/testdata/sf0.001"


def plain(w, exponent=4, shortest=6):
    """Every period, every place: stretches of equal words, the least period of each."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def dropped(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 3), (2, 7), (5, 5)])
def test_random_words(exponent, shortest):
    rnd = random.Random(exponent * 10 + shortest)
    for _ in range(1200):
        n, v, w = rnd.randrange(60), rnd.choice([1, 2, 3, 5]), []
        while len(w) < n:
            w += [rnd.randrange(v) for _ in range(rnd.randrange(1, 6))] * rnd.randrange(1, 8)
            w += [rnd.randrange(4) for _ in range(rnd.randrange(4))]
        assert periodic_runs.runs_of(np.array(w, np.int64), exponent, shortest) == plain(w, exponent, shortest)


def test_grams_of_large_vocabularies():
    """Ids so large that the numbers of several words must be ranked between."""
    w = np.array([3, 1, 4, 1, 5] * 9 + [9], np.int64) * (1 << 40)
    assert periodic_runs.runs_of(w) == [(0, 45, 5)]


def test_long_texts():
    """Long runs, and many places with one left word, take no square of the length."""
    assert periodic_runs.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert periodic_runs.runs_of(np.tile(np.arange(50), 1_200)) == [(0, 60_000, 50)]
    far = np.concatenate([np.arange(7) if i % 2 else 100 + i * 11 + np.arange(11) for i in range(4_000)])
    assert periodic_runs.runs_of(far) == []


def test_rows(spark):
    rows = [(1, "a b " * 5 + "c", "x", 7), (2, None, "x", 7), (3, "", None, 7), (4, " \t\n", "x", None), (None, "z " * 9, "x", 7),
            (1, "a b " * 5 + "c", "x", 7), (6, "one two three", "x", 7), (7, "é é é\x0bé\x0cé É\xa0é é é é é é é", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string, n_words int")
    got = periodic_runs.find_runs(docs)
    assert got.columns == ["doc_id", "runs", "n_words", "n_words_", "runs_", "collapsed"]
    out = sorted(((r["doc_id"], r["n_words_"], [tuple(x) for x in r["runs_"]], r["collapsed"], r["runs"], r["n_words"]) for r in got.collect()), key=str)
    want = []
    for i, t, a, b in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = plain(w)
        want.append((i, len(w), runs, " ".join(dropped(w, runs)), a, b))
    assert out == sorted(want, key=str)
    assert {x[0]: x[3] for x in out}[1] == "a b c"
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, exponent=1)


def test_query(spark):
    """Every document of the query against the scan, its altered words included."""
    got = {r["doc_id"]: r.asDict() for r in op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    altered = 0
    for r in docs:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"] or "") if x]
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            altered += 1
        runs = plain(w)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert got[r["doc_id"]] == {
            "doc_id": r["doc_id"], "n_runs": len(runs), "start": top[0], "length": top[1], "period": top[2],
            "exponent_milli": 1000 * top[1] // top[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(dropped(w, runs)).encode()).hexdigest()}
    assert altered > 5 and any(r["n_runs"] for r in got.values())


def test_planted_edges(spark):
    """Null, empty and one-word texts, and a null id, are left as they are or repeat themselves."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    docs = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], "one"), (ids[3], " a b  c d\n"), (None, "a b")], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in with_planted_runs(docs).collect()}
    assert (got[ids[0]], got[ids[1]], got[ids[2]]) == (None, "", "one")
    assert len(got[ids[3]].split()) == 4

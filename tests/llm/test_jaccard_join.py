import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pairmill.llm import jaccard_join as jj
from pairmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k=5, t=(75, 100)):
    import re
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append(frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    links = set()
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if t[1] * n >= t[0] * (len(s) + len(sets[j]) - n):
                links.add((i, j))
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), ids.get(root(i))) for i, r in enumerate(rows)], links


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def _corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    passage = text(40)
    rows = []
    for g in range(25):
        base = text(r.randint(3, 120))
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 22))):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    near = text(90)
    for _ in range(80):  # a large group of near copies, some far from most others
        w = list(near)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [" ".join(passage + text(r.randint(0, 30))) for _ in range(60)]
    rows += ["Same Text here", "same text HERE", "same\ttext\nhere ", "a b c d", "a b c d e", None, "", " \n", "x " * 3000, "x " * 2999]
    r.shuffle(rows)
    return [(i, x, "clash", 1) for i, x in enumerate(rows)] + [(3, rows[3], None, 1), (None, rows[5], None, 1), (None, "only null id here", None, 1)]


@pytest.mark.parametrize("seed, ranges", [(0, jj.RANGE), (1, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, ranges):
    monkeypatch.setattr(jj, "RANGE", ranges)
    rows = _corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string, n int")
    got = [tuple(x) for x in jj.join_sets(df).collect()]
    want, links = brute(rows)
    assert len(links) > 500
    assert _sorted(got) == _sorted(want)


def test_without_known_frequent_shingles(spark, monkeypatch):
    """When more shingles are frequent than the tasks are told, their long lists take the same way."""
    monkeypatch.setattr(jj, "FREQUENT_MAX", 3)
    monkeypatch.setattr(jj, "BLOCK", 16)
    rows = _corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string, n int")
    assert _sorted(tuple(x) for x in jj.join_sets(df).collect()) == _sorted(brute(rows)[0])


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(x) for x in QUERIES["op9_jaccard_join"](spark, SF).collect()]
    assert _sorted(got) == _sorted(brute(rows)[0])


def test_empty_and_threshold(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.join_sets(df).count() == 0
    for n in range(1, 200):
        assert jj.least_overlap(n, n, (75, 100)) <= n and jj.prefix_length(n, (75, 100)) >= 1
    assert np.unique(jj.shingle_sets([b"a b c d e f"], 5)[0]).size == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 75), (7, 7)]
    got = {r["node"]: r["root"] for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 75: 50}


def _packed(h, pos, sid, n):
    """A packed batch of entries as tasks hand them on: one set for each entry."""
    by = np.argsort(h)
    fields = [np.diff(h[by], prepend=np.uint64(0)), np.arange(len(h), dtype=np.uint32), pos[by].astype(np.uint32), sid[by], n[by].astype(np.uint32)]
    zipped = [jj._zip(f) for f in fields]
    return np.array([len(h), len(h), *map(len, zipped)], np.int64).tobytes() + b"".join(zipped)


def test_lists_hold_only_shingles_of_several_sets():
    """Entries of a hash range that are in one set only take little memory; those that sets share all come."""
    r = np.random.default_rng(0)
    size, blobs, shared = 50_000, [], r.integers(0, 1 << 40, 300).astype(np.uint64)
    for b in range(8):
        h = np.concatenate([r.integers(0, 1 << 40, size).astype(np.uint64), shared])
        blobs.append(_packed(h, np.zeros(len(h)), np.arange(len(h)) + b * len(h), np.full(len(h), 20)))
    rows = pd.DataFrame({"packed": blobs})
    tracemalloc.start()
    got = jj._listed((75, 100))(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(shared.astype(np.int64)) <= set(got["key"]) and (got["key"].value_counts()[shared.astype(np.int64)] == 8).all()
    assert peak < 40 * 8 * size
    alone = pd.DataFrame({"packed": [_packed(np.arange(5, dtype=np.uint64), np.zeros(5), np.arange(5), np.full(5, 20))]})
    assert jj._listed((75, 100))(alone).empty

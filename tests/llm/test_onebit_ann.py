import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm import onebit_ann as ann
from pairmill.llm.queries import QUERIES


def brute(rows, asks, k=5):
    """Exact neighbours of each asking id, by (cosine, id)."""
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float64)
    v = v / np.sqrt((v * v).sum(1, keepdims=True))
    out = {}
    for a, i in enumerate(ids):
        if asks(i):
            s = (v * v[a]).sum(1)
            out[i] = sorted((-round(float(x), 12), j) for x, j in zip(s, ids) if j != i)[:k]
    return out


def _found(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, want):
    return np.mean([len({j for _, j in found.get(i, [])} & {j for _, j in w}) / len(w) for i, w in want.items()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()
            if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    found = _found(QUERIES["op6_onebit_ann"](spark, path).collect())
    want = brute(rows, lambda i: i % 50 == 0)
    assert set(found) == set(want)
    assert recall(found, want) > 0.99
    for i, w in want.items():
        scores = {j: s for s, j in w}
        assert all(abs(scores[j] - s) < 1e-11 for s, j in found[i] if j in scores)


def test_blocks_copies_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 150)
    monkeypatch.setattr(ann, "QUERIES", 20)
    r = np.random.default_rng(0)
    v = r.normal(size=(900, 70))
    v[300:600] = v[0]  # a third of the rows are one vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = _found(ann.search(df, F.col("vec_id") % 10 == 0).collect())
    want = brute(rows, lambda i: i % 10 == 0)
    assert recall(found, want) > 0.97
    assert found[300] == want[300] and found[0] == want[0]


def test_edges(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(10, [1.0, 0.0]), (20, [1.0, 1.0]), (30, [-1.0, 0.0]), (40, [2.0, 0.0]), (50, [1e-200, 1e-200]), (60, [1.0, 2.0, 3.0])]
    rows = [(i, v, "x", 0.1) for i, v in bad + good + good[:2]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score double")
    found = _found(ann.search(df, F.col("vec_id") % 10 == 0).collect())
    assert [j for _, j in found[10]] == [40, 20, 50, 30]
    assert [j for _, j in found[20]] == [50, 10, 40, 30]
    assert 60 not in found and len(found) == 5
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    v, q = r.normal(size=(2000, 64)), r.normal(size=(50, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = ann.estimate(*ann.encode(v, turn), q, turn)
    true = ann.unit(q) @ ann.unit(v).T
    assert np.mean(np.abs(guess - true) <= error) > 0.995
    assert np.corrcoef(guess.ravel(), true.ravel())[0, 1] > 0.75

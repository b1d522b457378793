"""Near duplicates by odd sketches against comparing all sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm import odd_sketch as od
from pairmill.llm.queries import QUERIES

from .test_jaccard_join import _corpus, _sorted, brute

SF = "/root/testdata/sf0.01"
T = (85, 100)


def pair(rng, n, similarity):
    """Two sets of ``n`` hashes, and their similarity."""
    both = round(n * 2 * similarity / (1 + similarity))
    u = rng.integers(0, 2**64, size=2 * n - both, dtype=np.uint64)
    return np.sort(u[:n]), np.sort(u[n - both:]), both / (2 * n - both)


@pytest.mark.parametrize("n", [20, 400, 5_000])
def test_estimates(n):
    """The estimate is centred on the similarity, precise above the threshold, and no pair there is left out."""
    rng, far = np.random.default_rng(n), od.far_bits(0.85 - od.MARGIN)
    for similarity, width in ((1.0, 0.0), (0.95, 0.02), (0.9, 0.03), (0.86, 0.035)):
        errors = []
        for _ in range(60):
            a, b, exact = pair(rng, n, similarity)
            values = np.stack([od.samples(a), od.samples(b)])
            x, y = od.fold(values)
            bits = int(np.bitwise_count(x ^ y).sum())
            keys = od.band_keys(values)
            assert exact < 0.85 or (bits <= far and (keys[0] == keys[1]).any())
            errors.append(float(od.estimate(bits)) - exact)
        assert abs(np.mean(errors)) <= width / 3 and np.std(errors) <= width
    far_off = [pair(rng, 400, 0.4)[:2] for _ in range(60)]
    passed = sum(int(np.bitwise_count(np.bitwise_xor(*od.fold(np.stack([od.samples(a), od.samples(b)])))).sum()) <= far for a, b in far_off)
    assert passed == 0


def test_fold_counts_parity():
    """Each sample flips one bit; a bitmap is the XOR of its samples' bits, and one sample changes two bits at most."""
    v = np.arange(od.SAMPLES, dtype=np.uint32)[None, :].repeat(2, 0)
    v[1, 7] += 1
    x, y = od.fold(v)
    assert np.bitwise_count(x).sum() % 2 == od.SAMPLES % 2
    assert np.bitwise_count(x ^ y).sum() in (0, 2)
    assert od.estimate(0) == 1 and od.far_bits(1.0) == 0


def test_samples_in_steps(monkeypatch):
    s = np.sort(np.random.default_rng(1).integers(0, 2**64, size=5_000, dtype=np.uint64))
    whole = od.samples(s)
    monkeypatch.setattr(od, "STEP", 64)
    assert (od.samples(s) == whole).all()


@pytest.mark.parametrize("block, chunk", [(od.BLOCK, od.CHUNK), (8, 5)])
def test_against_brute_force(spark, monkeypatch, block, chunk):
    """Also with blocks so small that groups are cut and the rest is compared with all blocks, and with keys dealt to several tasks."""
    monkeypatch.setattr(od, "BLOCK", block)
    monkeypatch.setattr(od, "CHUNK", chunk)
    rows = _corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string, sid string, n int")
    want, links = brute(rows, t=T)
    assert len(links) > 300
    got = od.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert _sorted(tuple(x) for x in got.collect()) == _sorted(want)


def test_many_copies(spark):
    """Most rows are copies: of one text under many ids, one id, and null ids."""
    r = random.Random(8)
    base = [f"w{r.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(5, 300)] + [(2, " ".join(base))] * 20 + [(None, " ".join(base))] * 20
    rows += [(1000 + i, " ".join(base[:i] + ["new"] + base[i:])) for i in range(0, 200, 9)] + [(1, "other"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _sorted(tuple(x) for x in od.near_duplicates(df).collect()) == _sorted(brute(rows, t=T)[0])


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert od.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, None), (4, ""), (4, " \n"), (5, "a b")], "doc_id int, text string")
    assert _sorted(tuple(x) for x in od.near_duplicates(one).collect()) == [(4, 0, 4), (4, 0, 4), (5, 1, 5), (None, 0, None)]
    with pytest.raises(ValueError):
        od.near_duplicates(df, threshold=(70, 100))


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_odd_sketch"](spark, SF)
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
    assert _sorted(tuple(x) for x in got.drop("kept").collect()) == _sorted(brute(rows, t=T)[0])

import math
import random

import pytest
from pyspark.sql import functions as F

from pairmill.llm import mixing
from pairmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _rows(sizes, seed=0):
    r = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(1, 30))), 9, "x"))
            i += 1
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, weight int, block string")


def _by_source(out):
    return {r["source"]: r for r in out.groupBy("source").agg(
        F.first("weight").alias("weight"), F.sum("n_tokens").alias("tokens"), F.first("budget").alias("budget"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("seen"), F.max("n_tokens").alias("row"), F.min("copies").alias("least")).collect()}


def _brute(tokens, alpha):
    z = sum(t**alpha for t in tokens.values())
    return {s: t**alpha / z for s, t in tokens.items()}


def _bisect(holds):
    low, high = 0.0, 1.0
    if holds(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


SIZES = {"big": 900, "mid": 200, "small": 40, "tiny": 5}


def test_repetition_limit_and_cover(spark):
    rows = _rows(SIZES)
    got = _by_source(mixing.mix(_frame(spark, rows), max_repeat=4.0))
    tokens = {s: sum(len(t.split()) for _, x, t, *_ in rows if x == s) for s in SIZES}
    top = max(tokens.values())
    alpha = _bisect(lambda a: max((t / top) ** (a - 1) for t in tokens.values()) <= 4)
    for s, w in _brute(tokens, alpha).items():
        r = got[s]
        assert math.isclose(r["weight"], w, rel_tol=1e-8) and r["tokens"] == tokens[s]
        assert r["least"] >= 1 and r["seen"] <= 4 * tokens[s] + r["row"]
        assert r["budget"] <= r["seen"] < r["budget"] + r["row"]  # the row in which the budget ends counts
    assert abs(got["big"]["seen"] - tokens["big"]) <= 0
    assert math.isclose(got["tiny"]["budget"] / tokens["tiny"], 4, rel_tol=0.01)


@pytest.mark.parametrize("part", [0.55, 0.9, 1.0, 0.01])
def test_target_entropy_and_budget(spark, part):
    rows = _rows(SIZES, 1)
    budget = 7000
    got = _by_source(mixing.mix(_frame(spark, rows), target_entropy=part, max_repeat=None, budget_tokens=budget))
    tokens = {s: r["tokens"] for s, r in got.items()}
    entropy = lambda a: -sum(w * math.log(w) for w in _brute(tokens, a).values())
    alpha = _bisect(lambda a: entropy(a) <= part * math.log(len(tokens)) + 1e-12)
    for s, w in _brute(tokens, alpha).items():
        assert math.isclose(got[s]["weight"], w, rel_tol=1e-6)
        assert abs(got[s]["budget"] - w * budget) <= 0.51
        assert got[s]["budget"] <= got[s]["seen"] < got[s]["budget"] + got[s]["row"] or got[s]["budget"] == got[s]["seen"]


def test_edges(spark):
    rows = [(1, None, "a b c", 1, None), (2, None, None, 1, None), (None, "s", "", 1, None), (3, "empty", None, 1, None),
            (4, "s", "x " * 50_000, 1, None), (5, "s", "y", 1, None), (5, "s", "y", 1, None)]
    out = mixing.mix(_frame(spark, rows))
    assert out.columns == ["doc_id", "source", "text", "block", "n_tokens", "weight", "budget", "whole_passes", "in_last_pass", "copies"]
    got = out.collect()
    assert len(got) == 7 and all(r["copies"] >= 1 for r in got)
    assert [r["weight"] for r in got if r["source"] == "empty"] == [0.0]
    twice = [r["copies"] for r in got if r["doc_id"] == 5]
    assert twice[0] == twice[1]
    assert mixing.mix(_frame(spark, [])).count() == 0
    none = mixing.mix(_frame(spark, [(1, "a", None, 1, None)]))
    assert [r["copies"] for r in none.collect()] == [1]


def test_passes_are_permutations(spark):
    out = mixing.mix(_frame(spark, _rows(SIZES, 2)))
    rows = mixing.passes(out).collect()
    copies = {r["doc_id"]: r["copies"] for r in out.collect()}
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], set()).add(r["pass"])
        assert 0 <= r["position"] < 1
    assert {i: len(p) for i, p in seen.items()} == {i: n for i, n in copies.items() if n}
    tiny = [(r["pass"], r["position"], r["doc_id"]) for r in rows if r["source"] == "tiny"]
    order = [[i for _, _, i in sorted(x for x in tiny if x[0] == p)] for p in (0, 1)]
    assert sorted(order[0]) == sorted(order[1])
    places = spark.range(mixing.BLOCKS).select(mixing.place_of(F.col("id"), F.lit(77), F.lit(5)).alias("p"))
    assert places.distinct().count() == mixing.BLOCKS


def test_query(spark):
    got = QUERIES["op1_mix_sources"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect())
    assert all(r["copies"] >= 1 for r in got)

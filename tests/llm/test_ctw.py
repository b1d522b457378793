import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm import ctw
from pairmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _norm(t):
    return b" ".join(ctw.words_of(t.encode() if t else None)) + b"\n"


class Brute:
    """Context-tree weighting node by node, in plain Python."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, collections.defaultdict(lambda: [0, 0])
        self.below = collections.defaultdict(set)
        for t in texts:
            for ctx, node, bit in self.steps(t):
                for d in range(depth + 1):
                    self.n[ctx[:d], node][bit] += 1
                    if d < depth:
                        self.below[ctx[:d], node].add(ctx[: d + 1])
        self.memo = {}

    def steps(self, t):
        raw = b"\n" * self.depth + t
        for p in range(self.depth, len(raw)):
            ctx, node = tuple(raw[p - 1 - j] for j in range(self.depth)), 1
            for i in range(8):
                bit = raw[p] >> (7 - i) & 1
                yield ctx, node, bit
                node = 2 * node + bit

    def kt(self, key):
        a, b = self.n[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_p(self, ctx, node):
        if (ctx, node) not in self.memo:
            kt = self.kt((ctx, node))
            v = kt if len(ctx) == self.depth else np.logaddexp(math.log(.5) + kt, math.log(.5) + sum(self.log_p(c, node) for c in self.below[ctx, node]))
            self.memo[ctx, node] = float(v)
        return self.memo[ctx, node]

    def score(self, t):
        total = 0.0
        for ctx, node, bit in self.steps(t):
            path = [d for d in range(self.depth + 1) if (ctx[:d], node) in self.n]
            p, rest, mixed = .5, 1.0, 0.0
            for d in path:
                a, b = self.n[ctx[:d], node]
                p = (b + .5) / (a + b + 1)
                if d == path[-1]:
                    break
                stop = math.exp(math.log(.5) + self.kt((ctx[:d], node)) - self.log_p(ctx[:d], node))
                mixed, rest = mixed + rest * stop * p, rest * (1 - stop)
            q = mixed + rest * p
            total += math.log10(q if bit else 1 - q)
        return total


def _docs(seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 5))) for _ in range(25)]
    rows = [(i, r.choice([" ", "\n", "  \t"]).join(r.choice(words) for _ in range(r.randint(0, 30))).upper(), i % 3 != 0, 7) for i in range(40)]
    return rows + [(100, None, True, 7), (101, "", False, 7), (102, " \n", False, 7), (None, "abc É", None, 7), (5, rows[5][1], True, 7), (103, "z" * 60_000, False, 7)]


@pytest.mark.parametrize("chunk", [ctw.CHUNK, 200])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ctw, "CHUNK", chunk)
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, mine boolean, size int")
    got, n_train = ctw.score(df, F.col("mine"))
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    model = Brute([_norm(t) for _, t, x, _ in rows if x], ctw.DEPTH)
    count = collections.Counter(w for _, t, x, _ in rows if x for w in (*ctw.words_of(t.encode() if t else None), b"\n"))
    assert n_train == sum(count.values()) and len(got) == len(rows)
    want = []
    for i, t, x, _ in rows:
        w = [*ctw.words_of(t.encode() if t else None), b"\n"]
        base = sum(math.log10((count[v] + 1) / (n_train + len(count) + 1)) for v in w)
        want.append((i, bool(x), len(w), sum(count[v] > 0 for v in w), len(_norm(t)), base, model.score(_norm(t)) if i != 103 else None))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0))
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
        if b[6] is not None:
            assert math.isclose(a[6], b[6], rel_tol=2e-3, abs_tol=1e-3)  # half precision in the slot table
        assert math.isclose(a[7], -a[6] / math.log10(2) / a[4])


def test_probabilities_sum_to_one():
    texts = [_norm(t) for _, t, x, _ in _docs(3) if x]
    keys, n = np.unique(ctw.grams(texts), return_counts=True)
    nodes, parts = ctw.leaves(keys, n), []
    for depth in range(ctw.DEPTH, 1, -1):
        at, tag = ctw.slots(depth, nodes.key)
        parts.append((at, tag, ctw.small_side(nodes.n0, nodes.n1), nodes.stop.astype(np.float16), nodes.n0 + nodes.n1))
        nodes = ctw.parents(nodes)
    best = ctw._best(*(np.concatenate(x) for x in zip(*parts)))
    model = ctw._model([(0, len(best[0]), ctw._pack(best[0].astype(np.uint32), *best[1:4], best[4].astype(np.int64))),
                        (1, len(nodes.key), ctw._pack(nodes.key, nodes.n0, nodes.n1, nodes.log_p, nodes.stop))])
    for context in (b"abcab", b"zzzzz", b"\n\n\n\n\n"):
        k = int.from_bytes(context[::-1], "big") << 8
        assert abs((10 ** model.log10(np.arange(256) + k)).sum() - 1) < 1e-9


def _whole(keys, n):
    nodes, parts = ctw.leaves(keys, n), []
    for depth in range(ctw.DEPTH, 1, -1):
        at, tag = ctw.slots(depth, nodes.key)
        parts.append((at, tag, ctw.small_side(nodes.n0, nodes.n1), nodes.stop, nodes.n0 + nodes.n1))
        nodes = ctw.parents(nodes)
    best = ctw._best(*(np.concatenate(x) for x in zip(*parts)))
    return ctw._model([(0, len(best[0]), ctw._pack(*(x.astype(k) for x, k in zip(best, ctw.SLOT_KINDS)))),
                       (1, len(nodes.key), ctw._pack(nodes.key, nodes.n0, nodes.n1, nodes.log_p, nodes.stop))])


def test_large_counts():
    """A context with some 1e8 counts: neither the usual nor an unseen outcome gets probability 0."""
    times = 10**8
    texts = [b"that that the\n", b"this that\n"]
    keys, n = np.unique(ctw.grams(texts), return_counts=True)
    model, brute = _whole(keys, n * times), Brute(texts, ctw.DEPTH)
    for v in brute.n.values():
        v[:] = [x * times for x in v]
    for t in (*texts, b"that tha\n", b"that\xff\n"):
        assert math.isclose(model.log10(ctw.grams([t])).sum(), brute.score(t), rel_tol=1e-5, abs_tol=1e-5)


def test_all_nodes_kept():
    """No node of a text with a million of them is lost."""
    keys, n = np.unique(ctw.grams([random.Random(5).randbytes(40_000)]), return_counts=True)
    model, nodes = _whole(keys, n), ctw.leaves(keys, n)
    for depth in range(ctw.DEPTH, 1, -1):
        seen, side, _ = model.look(depth, nodes.key)
        assert seen.all() and (np.abs(side) > 0).all()
        nodes = ctw.parents(nodes)


def test_scores_are_exact(spark):
    rows = [r for r in _docs(7) if r[0] != 103]
    df = spark.createDataFrame(rows, "doc_id long, text string, mine boolean, size int").repartition(5)
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, F.col("mine"))[0].collect()}
    model = Brute([_norm(t) for _, t, x, _ in rows if x], ctw.DEPTH)
    for i, t, _, _ in rows:
        assert math.isclose(got[i], model.score(_norm(t)), rel_tol=1e-7)


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got, n = ctw.score(df, F.lit(False))
    assert n == 0 and {r["doc_id"]: round(r["bits_per_byte"], 9) for r in got.collect()} == {1: 8.0, 2: 8.0}
    got, n = ctw.score(df.limit(0), F.lit(True))
    assert n == 0 and got.count() == 0


def test_query(spark):
    got = QUERIES["op8_context_tree"](spark, SF).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train = collections.Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in (*ctw.words_of(t.encode()), b"\n"))
    n = sum(train.values())
    for r in got:
        w = [*ctw.words_of(rows[r["doc_id"]].encode()), b"\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[x] + 1) / (n + len(train) + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["bits_per_byte"] for r in held]) < 3.2

import random

import numpy as np

from pairmill.llm import fm_index as fm


def brute(texts, items, n):
    out = []
    for t in texts:
        w = fm.words_of(t.encode()) if t else []
        hit, names = set(), set()
        for name, text in items:
            iw = fm.words_of(text.encode())
            for i in range(max(1, len(iw) - n + 1)) if iw else ():
                g = iw[i: i + n]
                for j in range(len(w) - len(g) + 1):
                    if w[j: j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


def _case(seed):
    r = random.Random(seed)
    words = [chr(97 + i) for i in range(4)] + ["É1", "zz"]
    say = lambda k: r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(k))
    items = [(str(i), say(r.randint(0, 6))) for i in range(8)] + [("7", "a b"), ("dup", "A-b")]
    texts = [say(r.randint(0, 60)) for _ in range(40)] + ["", None, "---", "a", "a b", "x" * 3000, say(3000)]
    texts += [texts[-1], " ".join(["a"] * 500)]
    return texts, items


def test_suffix_order_and_search():
    r = np.random.default_rng(0)
    symbols = np.append(r.integers(0, 4, 400), 0)
    order = fm.suffix_order(symbols)
    zeros = np.cumsum(symbols == 0)
    key = [tuple((0, int(zeros[j])) if symbols[j] == 0 else (1, int(symbols[j])) for j in range(i, len(symbols))) for i in range(len(symbols))]
    assert order.tolist() == sorted(range(len(symbols)), key=key.__getitem__)
    index = fm.FMIndex(symbols, 4, sample=8)
    assert sorted(index.locate(np.arange(len(symbols))).tolist()) == list(range(len(symbols)))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fm, "SHARD_WORDS", 100)
    for seed in range(2):
        texts, items = _case(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS spans", "1 AS items")
        bench = spark.createDataFrame(items + [(None, None)], "item_id string, text string")
        for block in (8_000_000, 5):
            got = {r["doc_id"]: r for r in fm.find_spans(docs, bench, n=3, block_bytes=block).collect()}
            assert len(got) == len(texts)
            for i, (n_words, n_hit, names) in enumerate(brute(texts, items, 3)):
                assert got[i]["n_words"] == n_words
                assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == n_hit
                assert got[i]["items"] == names


def test_removal_and_empty(spark):
    docs = spark.createDataFrame([(1, "Keep this. The é quick-brown, fox! Stays"), (2, None), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "the é quick brown fox")], "item_id string, text string")
    got = {r["doc_id"]: r["text"] for r in fm.remove_spans(fm.find_spans(docs, bench)).collect()}
    assert got == {1: "Keep this. ! Stays", 2: None, 3: "nothing"}
    none = fm.find_spans(docs, bench.limit(0))
    assert all(r["spans"] == [] and r["items"] == [] for r in none.collect())
    assert fm.digests(fm.find_spans(docs.limit(0), bench)).count() == 0

"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pairmill.llm import spelling
from pairmill.llm.queries import damaged_words, op13_spelling_variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else len(b) - len(a) == 1 and a[i:] == b[i + 1:])


def plain(counts, ratio=10):
    near = {w: [] for w in counts}
    words = sorted(counts, key=len)
    for x, a in enumerate(words):
        for b in words[x + 1:]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, bs in near.items():
        top = min(bs, key=lambda b: (-counts[b], b), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] and counts[top] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_words(spark):
    """Short alphabets give many neighbours, chains of forms, ties, and repeated letters; also letters of two to four bytes."""
    rnd = random.Random(3)
    counts = {}
    for letters, longest, n in (("ab", 7, 120), ("abé", 6, 200), ("xyzż😀", 9, 250)):
        for _ in range(n):
            w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(longest + 1)))
            counts[w] = 10 ** rnd.randrange(5) * rnd.choice([1, 1, 2])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.group_variants(df)) == plain(counts)


def test_long_words(spark):
    """Around the length at which words leave the trie, and far beyond it, edits at every place."""
    rnd = random.Random(4)
    counts = {}
    for size in (spelling.LONG - 1, spelling.LONG, spelling.LONG + 1, 3_000):
        w = "".join(rnd.choice("abc") for _ in range(size))
        for at in [0, 1, size // 2, size - 1, size, *(rnd.randrange(size) for _ in range(6))]:
            counts[w] = 500
            counts[w[:at] + "z" + w[at:]] = 3
            counts[w[:at] + w[at + 1:]] = 40
            counts[w[:at] + "y" + w[at + 1:]] = 7
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.group_variants(df)) == plain(counts)


def test_rows(spark):
    """Nulls, repeats, the empty word, a zero count, a clashing extra column, no rows."""
    given = [("abc", 1, 5), ("abc", 2, 6), (None, 9, 7), ("abd", 30, 8), ("", 1, 9), ("a", None, 1), ("b", 100, 2), ("abd", None, 2)]
    df = spark.createDataFrame(given, "word string, n int, root int")
    got = rows(spelling.group_variants(df))
    assert got == plain({"abc": 3, "abd": 30, "": 1, "a": 0, "b": 100})
    assert spelling.group_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(df, ratio=1)


def test_words(spark):
    """Runs end at all but the given letters; only A-Z are lower-cased; null texts and ids."""
    texts = [(i, t) for i in range(40) for t in ("Straßenbahn ÉCLAIRSĀmixtures×plus÷ x9Quarterly_REPORTS", None, "", "short words")] + [(None, "nothing at all missing")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                want[run] += 1
    assert Counter(r["word"] for r in damaged_words(df, 7).collect()) == want


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {w: n for w, n in Counter(r["word"] for r in damaged_words(docs.select("doc_id", "text"), 7).collect()).items() if n >= 2}
    want = plain(counts)
    assert any(r[1] for r in want)
    assert rows(op13_spelling_variants(spark, SF)) == want

"""Periodic run detection: maximal pairs of a text's words, of bounded distance, by a bottom-up LCP-interval tree.

A run is a stretch of words in which words ``q`` apart are equal, at least
``exponent`` periods long, that neither neighbour extends.  Its first place and
the place ``q`` further on are a maximal pair: the same words follow both, as
far as the run goes, and the words before and behind differ.  Turned round, a
maximal pair of ``L`` words at distance ``q <= L / (exponent - 1)`` overlaps
itself, so it is a run as it stands and nothing has to be extended.  A pair at
a multiple of the period gives the same stretch; the least distance is kept.

* A pair needs ``LEAST`` equal words, and the places between its ends need a
  next occurrence near enough.  Places that cannot meet this are left out
  first, with array operations; most texts have none left.
* What is left falls into regions.  Each gets a suffix array by doubling, LCP
  values from the same ranks, and its LCP intervals from the leaves up.  A node
  keeps its places in order, all of them and by the word on their left.  The
  smaller child goes through its places and looks up those of the larger one
  within reach: one by one if they are few, by left word if the left words are
  fewer, and those of the same left word are never looked at.

Texts are independent, so the work is one map without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import free_names, map_arrow, text_of

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FAR = np.iinfo(np.int64).max


def _ranks(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of the values, and how many there are."""
    u, r = np.unique(x, return_inverse=True)
    return r, len(u)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each ``k`` consecutive ids, equal where and only where they are."""
    out, n = ids[: len(ids) - k + 1], int(ids.max()) + 1
    size = n
    for j in range(1, k):
        if size > (1 << 62) // n:
            out, size = _ranks(out)
        out = out * n + ids[j: j + len(out)]
        size *= n
    return out


def _stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(on.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def regions(ids: np.ndarray, least: int, ratio: int) -> list[tuple[int, int]]:
    """Ranges of places outside which no pair of ``least`` equal words lies at ``ratio`` times its distance or more.

    Of such a pair, each place up to ``least`` before its end has a next
    occurrence of its ``least`` words at the pair's distance or before, and
    they stand in a row.  So a row bounds the distance, and a place whose next
    occurrence is further falls out, which shortens its row.
    """
    if len(ids) <= least:
        return []
    key = _grams(ids, least)
    by = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    if not len(again):
        return []
    gap = np.full(len(key), FAR)
    gap[by[again]] = by[again + 1] - by[again]
    on = gap < FAR
    while True:
        a, b = _stretches(on)
        if not len(a):
            return []
        reach = (b - a + least - 1) // ratio
        at = np.flatnonzero(on)
        far = gap[at] > np.repeat(reach, b - a)
        if not far.any():
            break
        on[at[far]] = False
    out: list[tuple[int, int]] = []
    for lo, hi in zip(np.maximum(a - 1, 0).tolist(), np.minimum(b + reach + least, len(ids)).tolist()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and how many words each suffix shares with the one before it (0 for the first)."""
    n = len(ids)
    rank, size = _ranks(ids)
    levels, h = [], 1
    while size < n:
        levels.append((h, np.append(rank, -1).astype(np.int32)))
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - h)] = rank[h:] + 1
        rank, size = _ranks(rank * (n + 1) + behind)
        h *= 2
    sa = np.argsort(rank)
    shared = np.zeros(n, np.int64)
    i, j = sa[:-1], sa[1:]
    l = np.zeros(n - 1, np.int64)
    for h, r in reversed(levels):
        # equal ranks of two places mean h equal words: the end of the text is in one place only
        same = r[np.minimum(i + l, n)] == r[np.minimum(j + l, n)]
        l[same] += h
    shared[1:] = l
    return sa, shared


class _Node:
    """Places below a node of the tree: in order, and by left word."""

    __slots__ = ("at", "by_left")

    def __init__(self, place: int, left: int):
        self.at, self.by_left = [place], {left: [place]}


def maximal_pairs(ids: np.ndarray, least: int, ratio: int) -> Iterator[tuple[int, int, int]]:
    """(place, later place, length) of all maximal pairs of ``least`` words or more, ``ratio`` times their distance or more."""
    sa, shared = suffixes(ids)
    left = np.append(-1, ids[:-1]).tolist()

    def join(a: _Node, b: _Node, depth: int, found: list) -> _Node:
        if len(a.at) < len(b.at):
            a, b = b, a
        reach = depth // ratio
        for p in b.at:
            lo, hi = bisect_left(a.at, p - reach), bisect_right(a.at, p + reach)
            if lo == hi:
                continue
            mine = left[p]
            if hi - lo <= len(a.by_left):
                found += [(p, x, depth) if p < x else (x, p, depth) for x in a.at[lo:hi] if left[x] != mine]
            else:
                for word, at in a.by_left.items():
                    if word != mine:
                        found += [(p, x, depth) if p < x else (x, p, depth)
                                  for x in at[bisect_left(at, p - reach): bisect_right(at, p + reach)]]
        if len(b.at) == 1:
            insort(a.at, b.at[0])
        else:
            a.at += b.at
            a.at.sort()
        for word, at in b.by_left.items():
            have = a.by_left.get(word)
            if have is None:
                a.by_left[word] = at
            elif len(at) == 1:
                insort(have, at[0])
            else:
                have += at
                have.sort()
        return a

    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, _Node]] = []
    sa, shared = sa.tolist(), shared.tolist() + [0]
    for i, place in enumerate(sa):
        depth = shared[i + 1]
        if depth < least and not open_:
            continue
        node = _Node(place, left[place])
        while open_ and open_[-1][0] > depth:
            d, first = open_.pop()
            node = join(first, node, d, found)
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, join(open_[-1][1], node, depth, found))
        elif depth >= least:
            open_.append((depth, node))
        yield from found
        found.clear()


def runs_of(ids: np.ndarray, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    ratio = exponent - 1
    least = max(shortest - max(1, shortest // exponent), ratio)
    best: dict[tuple[int, int], int] = {}
    for lo, hi in regions(ids, least, ratio):
        for a, b, n in maximal_pairs(ids[lo:hi], least, ratio):
            if b - a + n >= shortest:
                key = (lo + a, lo + b + n)
                best[key] = min(best.get(key, b - a), b - a)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers that tell the words apart."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q: s + n] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def find_runs(docs: DataFrame, text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_words``, ``runs`` and ``collapsed``.

    Words: ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0.  ``runs``:
    array of ``start``, ``length``, ``period``, by start and period, of the runs
    of at least ``exponent`` periods and ``shortest`` words.  ``collapsed``: the
    words that no run holds after its first period, joined by one space.  Null,
    empty and blank texts have no words, no runs and an empty ``collapsed``.
    Each row is its own, so repeated rows, ids and null ids change nothing; runs
    never tie, as two of them differ in start, end or both.  A text of any
    length is one task's work.  Columns of ``docs`` with the names of the three
    new ones keep their names; the new one then gets an underscore behind its
    name.  An empty table gives no rows.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")
    others = [c for c in docs.columns if c != text_col]
    n_name, runs_name, text_name = free_names(others, "n_words", "runs", "collapsed")
    given, = free_names(others, "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in others], text_of(docs, text_col).cast("binary").alias(given))
    schema = StructType([docs.schema[c] for c in others])
    run_type = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = schema.add(n_name, "long").add(runs_name, ArrayType(run_type)).add(text_name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, texts = [], [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                words = text.split()  # bytes split at exactly [\x20\x09-\x0D]
                runs = runs_of(word_ids(words), exponent, shortest) if len(words) >= shortest else []
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(collapse(words, runs) if runs else words))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())],
                [*b.schema.names[:-1], n_name, runs_name, text_name])
    return map_arrow(rows, run, schema)

"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents inside a task.  Its words become symbols of the
benchmark's vocabulary (0: any other word, and the end of a document), the
symbol sequence is sorted by suffix, and the Burrows-Wheeler transform is kept
in a wavelet matrix.  All test phrases are searched backwards at once, the
rows found are walked to a sampled suffix position, and the positions become
removal spans.  Nothing is shuffled: each document's spans come from its own
shard.

Test phrases are handed to the tasks in blocks of a fixed size, one pass over
the documents for each block, so the size of a benchmark bounds no memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, map_arrow

#: Bytes outside ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` become spaces, A-Z lower case.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Words that a shard holds at least, and a suffix sample is taken every so many positions.
SHARD_WORDS, SAMPLE = 1_000_000, 32
#: Bytes of benchmark text handed to the tasks at a time.
BLOCK_BYTES = 8_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Phrases:
    """Windows of a block of benchmark items: distinct symbol rows, short ones padded with -1 on the left."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # (windows, words), the last word of each in the last column
    lengths: np.ndarray
    item_of: np.ndarray  # pairs (window, item index), by window
    items: list[str]


def phrases(items: list[tuple[str, str]], n: int) -> Phrases:
    """Windows of ``n`` consecutive words of each item; an item of fewer words, but not none, is one window."""
    vocabulary: dict[bytes, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    pairs: set[tuple[int, int]] = set()
    names: list[str] = []
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text.encode())]
        if not ids:
            continue
        names.append(name)
        for i in range(max(1, len(ids) - n + 1)):
            w = tuple(ids[i: i + n])
            pairs.add((seen.setdefault(w, len(seen)), len(names) - 1))
    rows = np.full((len(seen), n), -1, np.int64)
    for w, k in seen.items():
        rows[k, n - len(w):] = w
    return Phrases(vocabulary, rows, (rows >= 0).sum(1), np.array(sorted(pairs), np.int64).reshape(-1, 2), names)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.

    Each 0 is a separator smaller than every word and, among separators,
    ordered by position; so no comparison passes one.
    """
    n = len(symbols)
    zero = symbols == 0
    n_zero = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, symbols + n_zero - 1).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    ranked = rank[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))  # groups of one suffix are in place
    while len(at):
        mine = order[at]
        nxt = mine + step
        pair = rank[mine] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(pair)
        mine, pair = mine[by], pair[by]
        order[at] = mine
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        rank[mine] = np.repeat(at[starts], sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class Bits:
    """A bit vector with rank by 64-bit words."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix: symbol and rank queries for whole arrays at once."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for k in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (symbols >> k) & 1
            self.levels.append((k, Bits(bit.astype(bool)), int(len(symbols) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start = np.zeros_like(at)
        for k, bits, zeros in self.levels:
            one = ((symbol >> k) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for k, bits, zeros in self.levels:
            one = bits.get(at)
            symbol |= one << k
            a, b = bits.rank(start), bits.rank(at)
            start, at = np.where(one == 1, zeros + a, start - a), np.where(one == 1, zeros + b, at - b)
        return symbol, at - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the first suffix has the last symbol before it, which is a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.wavelet = Wavelet(before, n_symbols)
        # a walk ends at a sample: every few positions, and wherever a separator stands before
        marked = (order % sample == 0) | (before == 0)
        self.marked, self.sampled = Bits(marked), order[marked]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix row ranges (low, high) of each window, searched from its last word to its first."""
        n = self.first[-1]
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), n, np.int64)
        live = np.arange(len(windows))
        for j in reversed(range(windows.shape[1])):
            live = live[high[live] > low[live]]
            go = live[windows[live, j] >= 0]
            symbol = windows[go, j]
            # equal states are looked up once
            state, back = np.unique(np.stack([symbol, low[go], high[go]]), axis=1, return_inverse=True)
            a = self.first[state[0]] + self.wavelet.rank(state[0], state[1])
            b = self.first[state[0]] + self.wavelet.rank(state[0], state[2])
            low[go], high[go] = a[back.ravel()], b[back.ravel()]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, each walked back to a sampled one."""
        out, rows = np.empty(len(rows), np.int64), rows.copy()
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            done = self.marked.get(rows[open_]) == 1
            hit = open_[done]
            out[hit] = self.sampled[self.marked.rank(rows[hit])] + steps
            open_ = open_[~done]
            symbol, rank = self.wavelet.access(rows[open_])
            rows[open_] = self.first[symbol] + rank
            steps += 1
        return out


def search_shard(texts: list[list[bytes]], test: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document (a word list): merged spans of hit words, and the items that occur."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    get = test.vocabulary.get
    symbols = np.fromiter((get(w, 0) for t in texts for w in (*t, b"")), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    none: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
    if not len(test.windows) or not symbols.any():
        return none
    # words outside the vocabulary part the text; parts shorter than every window hold none
    parts = np.flatnonzero(symbols == 0)
    lengths = np.diff(np.concatenate([[-1], parts])) - 1
    short = lengths < test.lengths.min()
    keep = np.repeat(~short, lengths + 1)
    places = np.flatnonzero(keep)
    if not len(places):
        return none
    fm = FMIndex(symbols[places], len(test.vocabulary) + 1)
    low, high = fm.search(test.windows)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    if not len(found):
        return none
    rows = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = places[fm.locate(rows)]
    window = np.repeat(found, counts)
    by = np.argsort(start, kind="stable")
    start, window = start[by], window[by]
    stop = start + test.lengths[window]
    doc = np.searchsorted(ends, start, side="right")
    # spans that touch or overlap become one; a separator ends every document, so none crosses
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    a, b, d = start[at], np.maximum.reduceat(stop, at), doc[at]
    for x, y, k in zip((a - (ends - sizes)[d]).tolist(), (b - (ends - sizes)[d]).tolist(), d.tolist()):
        none[k][0].append((x, y))
    pairs = np.unique(np.stack([doc, window]), axis=1)
    first = np.searchsorted(test.item_of[:, 0], pairs[1], side="left")
    last = np.searchsorted(test.item_of[:, 0], pairs[1], side="right")
    for k, x, y in zip(pairs[0].tolist(), first.tolist(), last.tolist()):
        none[k][1].extend(test.items[i] for i in test.item_of[x:y, 1])
    return [(spans, sorted(set(items))) for spans, items in none]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word spans (start, end)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Bounded lists of items; the driver holds one at a time.  Null ids are the text "null"."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string"))
    block, size = [], 0
    for name, text in rows.where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text)
    yield block


def find_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text",
               item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus ``n_words``, ``spans`` (array of start, end in words) and ``items`` (ids as text, sorted).

    A window is ``n`` consecutive words of an item, or the whole of a shorter
    one; spans are the union of all its occurrences.  Columns of ``docs`` with
    these names are replaced.  Null and empty texts have no words and no
    spans; items without words are never found; repeated rows and items are
    treated one by one (an id that comes twice is listed once).  An empty
    benchmark finds nothing.
    """
    out = docs.drop("n_words", "spans", "items")
    schema = (out.select("*", F.lit(0).cast("bigint").alias("n_words"),
                         F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
                         F.array().cast("array<string>").alias("items"))).schema
    spark: SparkSession = docs.sparkSession
    (more,) = free_names(out.columns, "found")
    first = True
    for block in _blocks(benchmark, id_col, item_text_col, block_bytes):
        test = spark.sparkContext.broadcast(phrases(block, n))
        if first:
            out = out.select("*", F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
                             F.array().cast("array<string>").alias("items"))
        first = False
        out = map_arrow(out, _searcher(test, text_col, out.columns), schema)
    return out


def _searcher(test, text_col: str, columns: list[str]):
    text_at = columns.index(text_col)

    def flush(held: list[pa.RecordBatch], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        found = search_shard(texts, test.value)
        at = 0
        for b in held:
            mine = found[at: at + b.num_rows]
            words = texts[at: at + b.num_rows]
            at += b.num_rows
            old_spans, old_items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            spans, items = [], []
            for (s, i), os, oi in zip(mine, old_spans, old_items):
                spans.append([{"start": x, "end": y} for x, y in merged(s + [(o["start"], o["end"]) for o in os])])
                items.append(sorted({*i, *oi}))
            cols = list(b.columns)
            names = b.schema.names
            for name, values in (("n_words", pa.array([len(w) for w in words], pa.int64())),
                                 ("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))),
                                 ("items", pa.array(items, pa.list_(pa.string())))):
                cols[names.index(name)] = values
            yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                got = [words_of(t) if t else [] for t in b.column(text_at).cast(pa.binary()).to_pylist()]
                held.append(b)
                texts += got
                size += sum(map(len, got))
                if size >= SHARD_WORDS:
                    yield from flush(held, texts)
                    held, texts, size = [], [], 0
        if held:
            yield from flush(held, texts)
    return run


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: str | None, spans) -> str | None:
    """The text without the words of the spans; what stands between two words of a span goes as well."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(WORD_BYTES))]
    keep, last = [], 0
    for s in spans:
        a, b = at[s["start"]][0], at[s["end"] - 1][1]
        keep.append(raw[last:a])
        last = b
    keep.append(raw[last:])
    return b"".join(keep).decode()


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with the spans cut out of the texts; ``n_words``, ``spans`` and ``items`` are dropped."""
    schema = found.drop("n_words", "spans", "items").schema
    cols, names = schema.names, found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(names.index(text_col)), b.column(names.index("spans"))
            done = pa.array([cut_spans(t.as_py(), s.as_py()) if len(s.as_py() or ()) else t.as_py() for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([done if c == text_col else b.column(names.index(c)) for c in cols], cols)
    return map_arrow(found, run, schema)


"""LM scoring by context-tree weighting over bytes.

A text is its words, lower-cased (A-Z), parted by a space and ended by a line
feed.  Each byte is eight binary decisions; a node of the tree belongs to the
last d bytes (d up to ``DEPTH``) and the decisions already made, and holds how
often each outcome followed in training.  A node's own estimate is
Krichevsky-Trofimov's; its weighted probability is the mean of that estimate's
and of the product of its children's, so every depth has a weight that the
training text decides.  What training gathers are counts of byte strings, and
all of a node's probabilities follow from its counts: they are added up and
weighted from the leaves to the root in distributed steps.

A context that training never saw is scored by its longest seen suffix.  Every
chunk of texts asks for the scores of its distinct byte strings, dealt by the
last three bytes of context, and gets them in the same order back: a part of
them holds all nodes of depth 3 and more that its strings can need, and no node
is dropped.  The number of parts grows with the text.  Only the nodes of up to
two bytes of context, of which there are at most 255 for each of 65 793
contexts however much text there is, are handed to all tasks.

The base score is a word unigram model's.  The counts of a chunk's distinct
words are asked for in the same way, by hash range.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pairmill.session import scalar

from .common import LOWER_BYTES, by_group, map_arrow, staged
from .jaccard_join import word_hashes

#: Bytes of context, those by which the tree is parted, parts at least, and characters of text for one part more.
DEPTH, SPLIT, SUBTREES, PART_CHARS = 5, 3, 256, 50_000_000
#: Bytes of text packed at a time, entries of a range of word hashes, and byte strings added up or scored at a time.
CHUNK, WORD_RANGE, BLOCK = 2_000_000, 2_000_000, 1 << 18
END = b"\n"
#: Stands for the end among the hashes of words.
END_HASH = 1
HALF = math.log(0.5)
#: Scores of byte strings are sent as whole numbers: 2^-28 of a bit.
POINT = 2**28 / math.log10(2)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER_BYTES).split() if text else []


def grams(texts: list[bytes]) -> np.ndarray:
    """For each byte of the texts: the bytes before it, the nearest in the highest place, and the byte itself lowest.

    A text starts as if line feeds stood before it.
    """
    if not texts:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(END * DEPTH + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + DEPTH) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    key = raw[at].astype(np.int64)
    for j in range(1, DEPTH + 1):
        key |= raw[at - j].astype(np.int64) << (8 * (DEPTH + 1 - j))
    return key


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, carried up by eight steps for small arguments."""
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        small = x[low]
        out[low] -= np.log(small[:, None] + np.arange(8)).sum(1)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with these counts."""
    a, b = n0.astype(np.float64), n1.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


@dataclass
class Nodes:
    """Binary nodes of one depth: context and decisions (key), outcomes, logarithm of the weighted probability, own weight."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    log_p: np.ndarray
    stop: np.ndarray

    def take(self, rows) -> Nodes:
        return Nodes(self.key[rows], self.n0[rows], self.n1[rows], self.log_p[rows], self.stop[rows])


def leaves(keys: np.ndarray, counts: np.ndarray) -> Nodes:
    """Nodes of the full depth from byte strings and how often they are."""
    context, symbol = keys >> 8, keys & 255
    key = np.concatenate([(context << 8) | (1 << i) | (symbol >> (8 - i)) for i in range(8)])
    bit = np.concatenate([(symbol >> (7 - i)) & 1 for i in range(8)])
    n = np.tile(counts, 8)
    key, n0, n1 = _sums(key, n * (1 - bit), n * bit)
    return Nodes(key, n0, n1, log_kt(n0, n1), np.ones(len(key)))


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(key):
        return (key, *values)
    by = np.argsort(key, kind="stable")
    key = key[by]
    at = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return (key[at], *(np.add.reduceat(v[by], at) for v in values))


def parents(nodes: Nodes) -> Nodes:
    """The nodes one depth up; the farthest context byte is dropped."""
    key = ((nodes.key >> 16) << 8) | (nodes.key & 255)
    key, n0, n1, below = _sums(key, nodes.n0, nodes.n1, nodes.log_p)
    kt = log_kt(n0, n1)
    log_p = np.logaddexp(HALF + kt, HALF + below)
    return Nodes(key, n0, n1, log_p, np.exp(HALF + kt - log_p))


def small_side(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The smaller of both outcomes' probabilities, never rounded to 0, and negative if it is the outcome 0's."""
    return np.where(n1 <= n0, n1 + 0.5, -(n0 + 0.5)) / (n0 + n1 + 1.0)


def slots(depth: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low half of a node's name, which is its depth and its key."""
    name = np.int64(depth << 48) | key
    return name >> 32, (name & 0xFFFFFFFF).astype(np.uint32)


Side = tuple[np.ndarray, np.ndarray, np.ndarray]  # of nodes: key (sorted) or whether seen, small side, stop


NO_NODES: Side = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)


@dataclass
class Model:
    """Depths 0 and 1 as full tables, deeper nodes by sorted keys."""

    top: list[Side]
    deep: dict[int, Side]

    def look(self, depth: int, key: np.ndarray) -> Side:
        """Whether the node is known, the smaller side of its probabilities, and its own weight."""
        if depth < 2:
            return tuple(x[key] for x in self.top[depth])
        keys, side, stop = self.deep.get(depth, NO_NODES)
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key)), np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, side[at], stop[at]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Logarithm of each byte's probability after its context."""
        context, symbol = keys >> 8, keys & 255
        total = np.zeros(len(keys))
        for i in range(8):
            done = (1 << i) | (symbol >> (8 - i))
            bit = (symbol >> (7 - i)) & 1
            p = np.full(len(keys), 0.5)  # of a node that was never seen
            mixed, rest, stop = np.zeros(len(keys)), np.ones(len(keys)), np.zeros(len(keys))
            live = np.arange(len(keys))
            for depth in range(DEPTH + 1):
                key = ((context[live] >> (8 * (DEPTH - depth))) << 8) | done[live]
                seen, side, s = self.look(depth, key)
                live, side, s = live[seen], side[seen], s[seen]
                q = np.where((side > 0) == (bit[live] == 1), np.abs(side), 1 - np.abs(side))  # of the outcome that follows
                # the depth above has its own weight now that one more is known below
                part = rest[live] * stop[live]
                mixed[live] += part * p[live]
                rest[live] -= part
                p[live], stop[live] = q, s
            mixed += rest * p
            total += np.log10(mixed)
        return total


def _read(docs: DataFrame) -> DataFrame:
    """One row for each chunk of texts."""
    ids = docs.schema["doc_id"].dataType
    schema = (StructType().add("uid", "long").add("ids", ArrayType(ids)).add("sizes", ArrayType(docs.schema["size"].dataType))
              .add("trained", ArrayType(docs.schema["trained"].dataType)).add("a", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Scalar, bytes, bool]] = []
        id_type = None

        def out() -> pa.RecordBatch:
            texts = [t for _, t, _ in held]
            types = (pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary())
            cols = ((task << 32) + chunk, [i.as_py() for i, _, _ in held], [len(t) for t in texts], [x for _, _, x in held],
                    pa.compress(b"".join(texts), codec="zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types)], schema.names)

        size = 0
        for big in batches:
            for lo in range(0, big.num_rows, 128):
                b = big.slice(lo, 128)
                id_type = b.schema.field("doc_id").type
                for i, t, x in zip(b.column("doc_id"), b.column("text").cast(pa.binary()).to_pylist(), b.column("trained").to_pylist()):
                    held.append((i, b" ".join(words_of(t)) + END, bool(x)))
                    size += len(t or b"")
                if size >= CHUNK:
                    yield out()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield out()

    return map_arrow(docs.select("doc_id", "text", "trained"), run, schema)


def _texts(chunk: pa.Table | pa.RecordBatch) -> list[bytes]:
    sizes = np.array(chunk.column("sizes")[0].as_py(), np.int64)
    raw = pa.decompress(chunk.column("a")[0].as_py(), int(sizes.sum()), codec="zstd", asbytes=True)
    return [raw[e - s: e] for s, e in zip(sizes, np.cumsum(sizes))]


ASKED = "uid long, part int, n long, a binary, b binary"


def _asked(chunks: DataFrame, keys_of: Callable) -> DataFrame:
    """What each chunk asks: keys and counts by part.  Made again from the texts by every reader, as they take far less disk."""
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                cols = _cut(row.column("uid")[0].as_py(), *keys_of(_texts(row), np.array(row.column("trained")[0].as_py(), bool)))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], list(cols))
    return map_arrow(chunks.select("uid", "sizes", "trained", "a"), run, ASKED)


def _cut(uid: int, part: np.ndarray, keys: np.ndarray, n: np.ndarray) -> dict:
    """Keys, sorted in each part, and counts, packed for each part."""
    at = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(at[1:], len(part))
    return {"uid": [uid] * len(at), "part": part[at].tolist(), "n": (ends - at).tolist(),
            "a": [_zip(np.diff(keys[x:y], prepend=keys.dtype.type(0))) for x, y in zip(at, ends)],
            "b": [_zip(n[x:y].astype(np.uint32)) for x, y in zip(at, ends)]}


def strings(texts: list[bytes], subtrees: int, trained: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every byte's place among the distinct byte strings by subtree, and for these: subtree, string, training count."""
    codes, found = pd.factorize(grams(texts))
    n = np.bincount(codes[np.repeat(trained, [len(t) for t in texts])], minlength=len(found))
    part = (mix((found >> (8 * (DEPTH + 1 - SPLIT))).astype(np.uint64)) % np.uint64(subtrees)).astype(np.int64)
    by = np.lexsort((found, part))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return place[codes], part[by], found[by], n[by]


def _joined(rows: pa.Table | pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    cols = [rows.column(c).to_pylist() for c in ("n", "a", "b")]
    keys = [np.cumsum(_unzip(a, n, kind)).astype(kind) for n, a, _ in zip(*cols)]
    return np.concatenate(keys), np.concatenate([_unzip(b, n, np.uint32) for n, _, b in zip(*cols)])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct words (and the end), every token's place among them, and the texts' token counts."""
    h, sizes = word_hashes(texts)
    flat = np.full(len(h) + len(texts), END_HASH, np.uint64)
    is_word = np.ones(len(flat), bool)
    is_word[np.cumsum(sizes + 1) - 1] = False
    flat[is_word] = h
    codes, hashes = pd.factorize(flat)
    by = np.argsort(hashes)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return hashes[by], place[codes], sizes + 1


def _count_words(rows: pa.Table) -> pa.Table:
    """Training counts of a range's words, for each chunk in the order in which it asked; and a row of totals (uid -1)."""
    sizes = rows.column("n").to_numpy()
    hashes, n = _joined(rows, np.uint64)
    words, back = np.unique(hashes, return_inverse=True)
    total = np.bincount(back, weights=n.astype(np.float64), minlength=len(words)).astype(np.int64)
    answer = total[back]
    ends = np.cumsum(sizes)
    part = rows.column("part")[0].as_py()
    return pa.table({
        "uid": pa.array([*rows.column("uid").to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(sizes) + 1), pa.int32()),
        "n": pa.array([*sizes.tolist(), int((total > 0).sum())], pa.int64()),
        "total": pa.array([0] * len(sizes) + [int(total.sum())], pa.int64()),
        "counts": pa.array([*(_zip(answer[e - s: e]) for s, e in zip(sizes, ends)), b""], pa.binary())})


def _added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte strings of all chunks, sorted, and their counts; added up as they come, so chunks are not held unpacked."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [], 0
    for batch in rows.select(["n", "a", "b"]).to_batches(max_chunksize=64):
        k, c = _joined(batch, np.int64)
        held.append(_sums(k, c.astype(np.int64)))
        size += len(held[-1][0])
        if size > max(BLOCK, len(keys)):
            keys, counts = _sums(*(np.concatenate(x) for x in zip((keys, counts), *held)))
            held, size = [], 0
    return _sums(*(np.concatenate(x) for x in zip((keys, counts), *held)))


def _subtree(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, Nodes]]:
    """Depths and nodes of a part of the tree, from the full depth to that of the parts."""
    seen = counts > 0
    nodes = leaves(keys[seen], counts[seen])
    yield DEPTH, nodes
    for depth in range(DEPTH - 1, SPLIT - 1, -1):
        nodes = parents(nodes)
        yield depth, nodes


def _grow(rows: pa.Table) -> pa.Table:
    """The nodes of a part's lowest depth by the last byte of context."""
    for _, nodes in _subtree(*_added(rows)):
        pass
    first = nodes.key >> (8 * SPLIT)
    by = np.argsort(first, kind="stable")
    nodes, first = nodes.take(by), first[by]
    cut = np.flatnonzero(np.diff(first, prepend=-1))
    return _packed([(1, int(first[a]), int(b - a), _pack(*vars(nodes.take(slice(a, b))).values())) for a, b in zip(cut, np.append(cut[1:], len(first)))])


def _answer(rows: pa.Table, model: Model) -> pa.Table:
    """Logarithms of the probabilities of a part's byte strings, for each chunk in the order in which it asked."""
    keys, counts = _added(rows)
    below = {depth: (x.key, small_side(x.n0, x.n1), x.stop) for depth, x in _subtree(keys, counts)}
    model = Model(model.top, model.deep | below)
    value = np.concatenate([model.log10(keys[a: a + BLOCK]) for a in range(0, len(keys), BLOCK)])
    value = np.rint(value * -POINT).astype(np.int64)
    answers = []
    for n, a in zip(rows.column("n").to_pylist(), rows.column("a").to_pylist()):
        asked = np.cumsum(_unzip(a, n, np.int64))
        # equal places of all numbers together, which packs better
        answers.append(_zip(value[np.searchsorted(keys, asked)].view(np.uint8).reshape(-1, 8).T))
    return pa.table({"uid": rows.column("uid"), "part": rows.column("part"), "n": rows.column("n"), "counts": pa.array(answers, pa.binary())})


def _best(at, tag, side, stop, n):
    """Nodes in the order of their names, each once."""
    by = np.lexsort((-n, tag, at))
    name = (at[by].astype(np.int64) << 32) | tag[by]
    by = by[np.flatnonzero(np.diff(name, prepend=-1))]
    return at[by], tag[by], side[by], stop[by].astype(np.float64), n[by]


def _pack(*arrays: np.ndarray) -> bytes:
    zipped = [_zip(x) for x in arrays]
    return np.array([len(z) for z in zipped], np.int64).tobytes() + b"".join(zipped)


def _unpack(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(_unzip(blob[at: at + size], n, kind))
        at += size
    return out


SLOT_KINDS = (np.uint32, np.uint32, np.float64, np.float64, np.int64)
NODE_KINDS = (np.int64, np.int64, np.int64, np.float64, np.float64)
TREE = "kind int, part int, n long, packed binary"


def _packed(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("kind", "part", "n", "packed"), zip(*rows) if rows else ((),) * 4, types)})


def _settle(rows: pa.Table) -> pa.Table:
    """Of one last byte: the nodes of depth 2 by their names (kind 0) and those of depth 1 (kind 1)."""
    cols = (_unpack(b, n, *NODE_KINDS) for b, n in zip(rows.column("packed").to_pylist(), rows.column("n").to_pylist()))
    part, nodes = rows.column("part")[0].as_py(), Nodes(*(np.concatenate(x) for x in zip(*cols)))
    for _ in range(2, SPLIT):
        nodes = parents(nodes)
    two = _best(*slots(2, nodes.key), small_side(nodes.n0, nodes.n1), nodes.stop, nodes.n0 + nodes.n1)
    one = parents(nodes)
    return _packed([(0, part, len(two[0]), _pack(*(x.astype(k) for x, k in zip(two, SLOT_KINDS)))), (1, part, len(one.key), _pack(*vars(one).values()))])


def _model(tree: list) -> Model:
    """From the settled parts: the named nodes, and at most 256 * 255 nodes of depth 1, which give the root's."""
    m, ones, named = Model([], {}), [], []
    for kind, n, blob in tree:
        if kind:
            ones.append(_unpack(blob, n, *NODE_KINDS))
        else:
            at, tag, side, stop, _ = _unpack(blob, n, *SLOT_KINDS)
            named.append(((at.astype(np.int64) << 32) | tag, side, stop))
    if named:
        name, side, stop = (np.concatenate(x) for x in zip(*named))
        by = np.argsort(name)
        name, side, stop = name[by], side[by], stop[by]
        for depth in range(2, DEPTH + 1):
            x = slice(*np.searchsorted(name, [depth << 48, (depth + 1) << 48]))
            m.deep[depth] = name[x] & ((1 << 48) - 1), side[x], stop[x]
    one = Nodes(*(np.concatenate(x) for x in zip(*ones))) if ones else Nodes(*(np.zeros(0, k) for k in NODE_KINDS))
    for nodes, width in ((parents(one), 256), (one, 65536)):
        seen, side, stop = np.zeros(width, bool), np.zeros(width), np.zeros(width)
        seen[nodes.key], side[nodes.key], stop[nodes.key] = True, small_side(nodes.n0, nodes.n1), nodes.stop
        m.top.append((seen, side, stop))
    return m


def score(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Scores of all rows under models learned from those where ``trained`` holds; and the number of training tokens.

    Columns: ``doc_id``, ``trained``, ``n_tokens`` (words and an end),
    ``n_known`` (tokens with a training count), ``n_bytes``, ``base_score``
    (log10, word unigrams with one added to each count and one unknown word),
    ``score`` (log10 probability of the text) and ``bits_per_byte``.  Null
    text is empty: one end.  A null ``trained`` counts as false.  Repeated
    rows count and score one by one; null ids stay.  Without training rows
    every byte has probability 1/256.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(trained, F.lit(False)).alias("trained"), F.lit(0).cast("bigint").alias("size"))
    chars = scalar(docs.agg(F.sum(F.length("text"))), 0)
    parts = max(1, math.ceil(chars / 24 / WORD_RANGE))  # a distinct word of a chunk for every 24 characters or so
    subtrees = max(SUBTREES, math.ceil(chars / PART_CHARS))
    read = staged(_read(docs), "ctw-read")

    def word_keys(texts: list[bytes], is_trained: np.ndarray) -> tuple[np.ndarray, ...]:
        hashes, numbers, sizes = tokens(texts)
        part = (hashes.astype(np.float64) / 2.0**64 * parts).astype(np.int64)
        return part, hashes, np.bincount(numbers[np.repeat(is_trained, sizes)], minlength=len(hashes))

    def all_strings(texts: list[bytes], is_trained: np.ndarray) -> tuple[np.ndarray, ...]:
        return strings(texts, subtrees, is_trained)[1:]

    def trained_strings(texts: list[bytes], is_trained: np.ndarray) -> tuple[np.ndarray, ...]:
        texts = [t for t, x in zip(texts, is_trained) if x]
        return all_strings(texts, np.ones(len(texts), bool))

    words = _asked(read, word_keys)
    counted = staged(words.groupBy("part").applyInArrow(by_group(_count_words), "uid long, part int, n long, total long, counts binary"), "ctw-words")
    total = counted.where("uid = -1").agg(F.sum("total").alias("n"), F.sum("n").alias("v")).collect()[0]
    n_train, n_words = total["n"] or 0, total["v"] or 0
    grown = _asked(read, trained_strings).select("part", "n", "a", "b").groupBy("part").applyInArrow(by_group(_grow), TREE)
    settled = grown.groupBy("part").applyInArrow(by_group(_settle), TREE).select("kind", "n", "packed").toArrow()
    model = _model(list(zip(*(settled.column(c).to_pylist() for c in settled.column_names))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = _asked(read, all_strings).groupBy("part").applyInArrow(by_group(lambda rows: _answer(rows, shared.value)), "uid long, part int, n long, counts binary")
    id_type = docs.schema["doc_id"].dataType
    schema = (StructType().add("doc_id", id_type).add("trained", "boolean").add("n_tokens", "long").add("n_known", "long")
              .add("n_bytes", "long").add("base_score", "double").add("score", "double").add("bits_per_byte", "double"))

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.slice(0, 1)
        sizes = np.array(row.column("sizes")[0].as_py(), np.int64)
        ends = np.cumsum(sizes)
        mine = _texts(row)
        hashes, numbers, n_tokens = tokens(mine)

        def answer(kind: str) -> list[tuple[bytes, int]]:
            got = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part")
            return list(zip(got.column("counts").to_pylist(), got.column("n").to_pylist()))

        known = np.concatenate([_unzip(b, n, np.int64) for b, n in answer("words")])
        if len(known) != len(hashes):
            raise ValueError("a chunk's words and their counts differ in number")
        each = np.log10((known + 1) / (n_train + n_words + 1))[numbers]
        start = np.cumsum(n_tokens) - n_tokens
        places, _, found, _ = strings(mine, subtrees, np.zeros(len(mine), bool))
        each_byte = np.concatenate([_unzip(b, 8 * n, np.uint8).reshape(8, n).T.copy().view(np.int64)[:, 0] for b, n in answer("grams")])
        if len(each_byte) != len(found):
            raise ValueError("a chunk's byte strings and their scores differ in number")
        score = np.add.reduceat(each_byte[places], ends - sizes) / -POINT
        return pa.table({
            "doc_id": row.column("ids").combine_chunks().flatten(), "trained": row.column("trained").combine_chunks().flatten(),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(np.add.reduceat((known > 0)[numbers].astype(np.int64), start)),
            "n_bytes": pa.array(sizes), "base_score": pa.array(np.add.reduceat(each, start)), "score": pa.array(score),
            "bits_per_byte": pa.array(-score / math.log10(2) / sizes)})

    asked = (counted.where("uid >= 0").select("uid", "part", "n", "counts", F.lit("words").alias("kind"))
             .unionAll(scored.select("uid", "part", "n", "counts", F.lit("grams").alias("kind"))))
    return read.groupBy("uid").cogroup(asked.groupBy("uid")).applyInArrow(by_group(finish), schema), n_train

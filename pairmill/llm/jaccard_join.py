"""N-gram Jaccard join: exact links between word shingle sets, with skipping by set relations.

Sets are ordered by how often their shingles occur, rare ones first, so sets
that link share a shingle among the first quarter of their own order; those
go into lists.  Equal sets are one set from the start.

* Lists by position: a list's sets are kept by length, and what length and
  position rule out is skipped; a set that can link with none of a list leaves it.
* Lists with the same first set (by a hash) are answered together, so a group
  of near copies meets in few places and its sets travel a few times, not once
  for each pair.  There the sets are taken in an order that brings similar ones
  together, and each set's overlaps are derived from those of the one before,
  by the lists of the shingles in which the two differ.  Links that join
  nothing new are not returned.
* A group of more sets than a block holds is cut into blocks, and its first set
  goes into each.  Only sets that are then outside the group's largest
  component are answered against the group's other blocks.

Frequent shingles are found by counting every shingle of every text: tasks
hand on sorted hashes as packed differences, by hash range.  The counts only
order the shingles; links are decided on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairmill.session import scalar

from .common import LOWER_BYTES, by_group, map_arrow, release, staged

#: A shingle of so many texts counts as frequent; the tasks know the most frequent ones, up to a bound (16 MB).
FREQUENT, FREQUENT_MAX = 32, 1_000_000
#: Shingles that a task holds before it packs them, those of a hash range, and bytes hashed at a time.
HELD, RANGE, BYTES = 750_000, 2_000_000, 1 << 20
#: Ids handed to all tasks at most (24 MB); beyond, the texts are joined.
IDS_MAX = 1_000_000
#: Sets of a block, and sets that a task takes up together.
BLOCK, TOGETHER = 512, 256

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: A random number for each byte after lower-casing, and an odd base with its inverse modulo 2^64.
LETTERS = mix(np.frombuffer(LOWER_BYTES, np.uint8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
BASE = 0xD6E8FEB86659FD93
UNBASE = pow(BASE, -1, 1 << 64)
IS_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and its inverse, as many as were needed yet."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n + n // 4), _powers(UNBASE, n + n // 4)
        return cls.up, cls.down


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of bytes with white space at both ends: differences of a running polynomial sum."""
    raw = np.frombuffer(block, np.uint8)
    up, down = _Powers.to(len(raw))
    white = IS_WHITE[raw]
    edge = np.diff(white)
    start, stop = np.flatnonzero(edge & white[:-1]) + 1, np.flatnonzero(edge & ~white[:-1]) + 1
    run = np.cumsum(LETTERS[raw] * up[: len(raw)])
    return start, mix((run[stop - 1] - run[start - 1]) * down[start] + (stop - start).astype(np.uint64))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has.  Long texts are hashed in pieces that end at spaces."""
    data = b" ".join([b"", *(t or b"" for t in texts), b""])
    starts, hashes, at = [], [], 0
    while at < len(data) - 1:
        end = at + BYTES
        if end < len(data) - 1:
            end = max(data.rfind(b" ", at + 1, end), 0) or data.find(b" ", end)
        else:
            end = len(data) - 1
        start, h = _hash_block(data[at: end + 1])
        starts.append(start + at)
        hashes.append(h)
        at = end
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends, side="right"), prepend=0)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    if not texts:
        return []
    h, sizes = word_hashes(texts)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        whole += h[j: j + len(whole)] * odd[j]
    whole = mix(whole)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            s = np.sort(whole[at: at + n - k + 1])
            new = s[1:] != s[:-1]
            out.append(s if new.all() else s[np.concatenate([[True], new])])
        elif n:
            out.append(mix(np.array([(h[at: at + n] * odd[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n_a, n_b, t: tuple[int, int]):
    """Smallest intersection of linked sets: 100 i >= 75 (a + b - i), for t = (75, 100)."""
    return -(-t[0] * (n_a + n_b) // (t[0] + t[1]))


def prefix_length(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1 if n else 0


@dataclass
class Frequent:
    """Frequent hashes (their leading bits), sorted, and in how many texts each was found."""

    shift: int
    hashes: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.leading = np.zeros(1 << 22, bool)
        self.leading[(self.hashes << np.uint64(self.shift)) >> np.uint64(42)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.leading[h >> np.uint64(42)])
        if len(maybe):
            short = h[maybe] >> np.uint64(self.shift)
            at = np.minimum(np.searchsorted(self.hashes, short), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == short, self.counts[at], 0)
        return out


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 128, size: int = 2 * BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows and bytes of text, but of one row at least."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi


def _texts(b: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return b.column(name).cast(pa.binary()).to_pylist()


def frequent_shingles(docs: DataFrame, k: int, ranges: int, bits: int) -> Frequent:
    """The shingles found in most texts, counted over all of them."""
    shift = 64 - bits

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) >> np.uint64(shift), return_counts=True)
            part = (h.astype(np.float64) / 2.0**bits * ranges).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            cols: list[list] = [[], [], [], [], []]
            for a, b in zip(cut, np.append(cut[1:], len(h))):
                gaps = np.diff(h[a:b], prepend=h[a])
                wide = np.uint32 if gaps.max() < 2**32 else np.uint64
                for c, v in zip(cols, (int(part[a]), int(h[a]), int(b - a) * (1 if wide is np.uint32 else -1), _zip(gaps.astype(wide)),
                                       _zip(np.minimum(n[a:b], 65535).astype(np.uint16)))):
                    c.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                              ["part", "first", "n", "gaps", "counts"])
        size = 0
        for b in _pieces(batches):
            got = shingle_sets(_texts(b), k)
            held += [s for s in got if len(s)]
            size += sum(map(len, got))
            if size >= HELD and held:
                yield out()
                size = 0
        if held:
            yield out()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        hs, ns = [], []
        for r in rows.itertuples():
            kind = np.uint32 if r.n > 0 else np.uint64
            hs.append(np.cumsum(_unzip(r.gaps, abs(r.n), kind).astype(np.uint64)) + np.uint64(r.first))
            ns.append(_unzip(r.counts, abs(r.n), np.uint16))
        h, n = np.concatenate(hs), np.concatenate(ns)
        del hs, ns
        by = np.argsort(h)
        h, n = h[by], n[by]
        del by
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.add.reduceat(n, cut, dtype=np.int64)
        often = total >= FREQUENT
        return pd.DataFrame({"h": h[cut][often].astype(np.int64), "n": total[often]})

    packed = map_arrow(docs.select("text"), pack, "part int, first long, n long, gaps binary, counts binary")
    top = (packed.groupBy("part").applyInPandas(by_group(count), "h long, n long")
           .orderBy(F.desc("n"), "h").limit(FREQUENT_MAX).toArrow())
    h, n = top.column("h").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    by = np.argsort(h)
    return Frequent(shift, h[by], n[by])


def _entries(docs: DataFrame, shared: Broadcast, k: int, t: tuple[int, int], ranges: int, bits: int) -> DataFrame:
    """One row for each text (``doc_id``, ``n``, ``sid``), one for each frequent prefix shingle (``key``,
    ``sid``), and the other prefix shingles packed by hash range (``part``, ``packed``)."""
    schema = (StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n", "integer").add("sid", "long").add("key", "long")
              .add("part", "integer").add("packed", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        size = 0
        id_type = None

        def batch(size: int, /, **cols) -> pa.RecordBatch:
            types = {"doc_id": id_type, "n": pa.int32(), "sid": pa.int64(), "key": pa.int64(), "part": pa.int32(), "packed": pa.binary()}
            return pa.RecordBatch.from_arrays([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], x) if c in cols else pa.nulls(size, x)
                                               for c, x in types.items()], list(types))

        def out() -> pa.RecordBatch:
            # a list may serve two shingles that agree in so many bits, which costs a comparison at most
            h = np.concatenate([x for _, x, _ in held]) >> np.uint64(64 - bits)
            pos = np.concatenate([p for _, _, p in held]).astype(np.uint32)
            of = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for _, x, _ in held])
            sids = np.array([s for s, _, _ in held], np.int64)
            lens = np.array([ns[s] for s, _, _ in held], np.int64)
            by = np.argsort(h)
            h, pos, of = h[by], pos[by], of[by]
            part = (h.astype(np.float64) / 2.0**bits * ranges).astype(np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            parts, blobs = [], []
            for a, b in zip(cut, np.append(cut[1:], len(h))):
                used, at = np.unique(of[a:b], return_inverse=True)
                fields = [np.diff(h[a:b], prepend=np.uint64(0)), at.astype(np.uint32), pos[a:b], sids[used], lens[used].astype(np.uint32)]
                zipped = [_zip(f) for f in fields]
                head = np.array([b - a, len(used), *map(len, zipped)], np.int64).tobytes()
                parts.append(int(part[a]))
                blobs.append(head + b"".join(zipped))
            held.clear()
            seen.clear()
            ns.clear()
            return batch(len(parts), part=parts, packed=blobs)

        ns: dict[int, int] = {}
        for b in _pieces(batches):
            id_type = b.schema.field("doc_id").type
            sets = shingle_sets(_texts(b), k)
            ids = [set_id(s) if len(s) else 0 for s in sets]
            yield batch(b.num_rows, doc_id=b.column("doc_id"), n=[len(s) for s in sets], sid=ids)
            keys, key_sid = [], []
            for s, sid in zip(sets, ids):
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                df = order.of(s)
                first = np.argsort(df, kind="stable")[: prefix_length(len(s), t)] if df.any() else np.arange(prefix_length(len(s), t))
                h, hot = s[first], df[first] > 0
                keys += h[hot].astype(np.int64).tolist()
                key_sid += [sid] * int(hot.sum())
                cold = np.flatnonzero(~hot)
                if len(cold):
                    ns[sid] = len(s)
                    held.append((sid, h[cold], cold))
                    size += len(cold)
            if keys:
                yield batch(len(keys), key=keys, sid=key_sid)
            if size >= HELD // 3:
                yield out()
                size = 0
        if held:
            yield out()

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _unpack(blob: bytes, of_shared=None) -> tuple[np.ndarray, ...]:
    """Hashes of a packed batch in order; with ``of_shared``, a function of them that tells the wanted ones: these, their sets, lengths and positions."""
    n, m, *sizes = np.frombuffer(blob, np.int64, 7).tolist()
    ends = np.cumsum([56, *sizes]).tolist()
    gaps, *rest = [(blob[a:b], count, kind) for a, b, count, kind in
                   zip(ends, ends[1:], (n, n, n, m, m), (np.uint64, np.uint32, np.uint32, np.int64, np.uint32))]
    h = np.cumsum(_unzip(*gaps))
    if of_shared is None:
        return (h,)
    at = np.flatnonzero(of_shared(h))
    of, pos, sids, lens = (_unzip(*x) for x in rest)
    return h[at], sids[of[at]], lens[of[at]], pos[at]


def _listed(t: tuple[int, int]):
    """Lists of a hash range: (``key``, ``sid``) of the sets that can link with another one of their list.

    Each list is in order of length.  A set is held against the next, the one
    after and so on, as long as its length allows: beyond the first that is
    too long, the rest of the list is skipped for it.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # most shingles are in one set only: of those, only the hashes are ever held
        every = np.concatenate([_unpack(p)[0] for p in rows["packed"]])
        every.sort()
        shared = every[1:][every[1:] == every[:-1]]
        shared = shared[np.append(True, shared[1:] != shared[:-1])] if len(shared) else shared
        del every

        def of_shared(h: np.ndarray) -> np.ndarray:
            return shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h if len(shared) else np.zeros(len(h), bool)
        h, sid, n, pos = (np.concatenate(c) for c in zip(*[_unpack(p, of_shared) for p in rows["packed"]]))
        by = np.lexsort((sid, n, h))
        h, sid, n, pos = h[by], sid[by], n[by].astype(np.int64), pos[by].astype(np.int64)
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        h, sid, n, pos = h[fresh], sid[fresh], n[fresh], pos[fresh]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(h)))
        stop = np.repeat(start + size, size)
        size = np.repeat(size, size)
        useful = size > FREQUENT  # only if more shingles are frequent than the tasks know
        i = np.flatnonzero((size > 1) & ~useful)
        for gap in range(1, FREQUENT):
            i = i[i + gap < stop[i]]
            i = i[least_overlap(n[i], n[i + gap], t) <= n[i]]
            if not len(i):
                break
            left = np.minimum(n[i] - pos[i], n[i + gap] - pos[i + gap])
            x = i[left >= least_overlap(n[i], n[i + gap], t)]
            useful[x] = useful[x + gap] = True
        return pd.DataFrame({"key": h[useful].astype(np.int64), "sid": sid[useful]})
    return run


def _sent(docs: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """The hashes of each routed set (``doc_id``: a document that has it, ``sid``, ``to``: array of groups), once for each group.

    Of a hash 48 bits are sent, which tell the shingles of two sets apart.  A
    task sends a set once, so a repeated document does not multiply it.
    """
    few = routes.limit(IDS_MAX + 1).count() <= IDS_MAX
    side = routes.withColumnRenamed("doc_id", "_id")
    joined = docs.join(F.broadcast(side) if few else side, docs["doc_id"].eqNullSafe(F.col("_id"))).select("text", "sid", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _pieces(batches):
            rows: list[tuple] = []
            for s, sid, to in zip(shingle_sets(_texts(b), k), b.column("sid").to_pylist(), b.column("to").to_pylist()):
                if len(s) and sid not in seen and set_id(s) == sid:
                    seen.add(sid)
                    packed = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
                    rows += [(x["first"], x["z"], x["x"], x["ask"], sid, x["label"], packed) for x in to]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT_ARROW)], SENT_ARROW)
    return map_arrow(joined, run, SENT)


SENT = "first long, z int, x int, ask boolean, sid long, label long, hashes binary"
SENT_ARROW = pa.schema([("first", pa.int64()), ("z", pa.int32()), ("x", pa.int32()), ("ask", pa.bool_()), ("sid", pa.int64()),
                        ("label", pa.int64()), ("hashes", pa.binary())])
ROUTE = "array<struct<first:bigint,z:int,x:int,ask:boolean,label:bigint>>"


def _hashes(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _answers(t: tuple[int, int]):
    """Links in each group (``first``, ``z``, ``x``) of the rows, between a set that asks and any, that join two labels."""
    def group(ask: list[bool], sids: list[int], labels: np.ndarray, sets: list[np.ndarray], out: list[tuple[int, int]]) -> None:
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(flat, kind="stable")
        flat, of = flat[by], of[by]
        index = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        known, ends = flat[index], np.append(index[1:], len(flat))

        def overlaps(s: np.ndarray) -> np.ndarray:
            """How many of these shingles each set has."""
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            at = at[known[at] == s]
            size = ends[at] - index[at]
            rows = np.repeat(index[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            return np.bincount(of[rows], minlength=len(sets))

        # sets with the same smallest hash are likely similar
        order = sorted((i for i in range(len(sets)) if ask[i]), key=lambda i: (int(mix(sets[i]).min()), sids[i]))
        last, same = np.zeros(0, np.uint64), np.zeros(len(sets), np.int64)
        for i in order:
            s = sets[i]
            more, less = np.setdiff1d(s, last, assume_unique=True), np.setdiff1d(last, s, assume_unique=True)
            same = same + overlaps(more) - overlaps(less) if len(more) + len(less) < len(s) else overlaps(s)
            last = s
            hit = np.flatnonzero((t[1] * same >= t[0] * (len(s) + sizes - same)) & (labels != labels[i]))
            new, one = np.unique(labels[hit], return_index=True)
            for j in hit[one].tolist():
                out.append((min(sids[i], sids[j]), max(sids[i], sids[j])))
            labels[np.isin(labels, new)] = labels[i]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("first", "ascending"), ("z", "ascending"), ("x", "ascending"), ("sid", "ascending")])
        key = np.stack([rows.column(c).to_numpy() for c in ("first", "z", "x")])
        sid = rows.column("sid").to_numpy()
        fresh = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))
        keep = fresh | np.append(True, sid[1:] != sid[:-1])
        cut = np.flatnonzero(fresh)
        out: list[tuple[int, int]] = []
        for a, b in zip(cut, np.append(cut[1:], len(sid))):
            mine = rows.slice(a, b - a).filter(pa.array(keep[a:b]))
            if len(mine) > 1:
                group(mine.column("ask").to_pylist(), mine.column("sid").to_pylist(), mine.column("label").to_numpy().copy(),
                      [_hashes(h) for h in mine.column("hashes").to_pylist()], out)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def _answered(docs: DataFrame, routes: DataFrame, classes: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Links found by sending sets to groups; ``routes``: ``first``, ``z``, ``x``, ``ask``, ``sid``, ``label``."""
    to = routes.groupBy("sid").agg(F.collect_list(F.struct("first", "z", "x", "ask", "label")).cast(ROUTE).alias("to"))
    to = staged(to.join(classes, "sid").select(F.col("first").alias("doc_id"), "sid", "to"), "jaccard-routes")
    buckets = max(1, math.ceil(scalar(to.agg(F.sum(F.size("to"))), 0) / TOGETHER))
    sent = _sent(docs, to, k).withColumn("bucket", F.pmod(F.xxhash64("first", "z", "x"), F.lit(buckets)))
    return staged(sent.groupBy("bucket").applyInArrow(by_group(_answers(t)), "a long, b long"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for all nodes of edges ``a``, ``b``, by alternating stars."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "component-edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).collect()[0]
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(down.select("u", F.col("m").alias("v"))).distinct())
        now = staged(small, "component-edges")


def _label(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``sets`` with ``label``, a set's root or itself."""
    return sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")


def _links(docs: DataFrame, lists: DataFrame, classes: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Links that join all sets which links between sets of a list join."""
    rank = F.struct(F.xxhash64("sid"), "sid")
    firsts = lists.groupBy("key").agg(F.min(rank)["sid"].alias("first"), F.max(rank)["sid"].alias("other")).where("first <> other")
    # sets that share a list share its first set
    groups = staged(lists.join(firsts.drop("other"), "key").select("first", "sid").distinct(), "jaccard-groups")
    sizes = staged(groups.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "jaccard-sizes")
    sized = groups.join(sizes, "first")
    block = F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks")).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    inside = F.when(F.col("sid") == F.col("first"), all_of(F.col("blocks"))).otherwise(F.array(block))
    routes = sized.select("first", "sid", F.explode(inside).alias("z")).select(
        "first", "z", F.col("z").alias("x"), F.lit(True).alias("ask"), "sid", F.col("sid").alias("label"))
    links = _answered(docs, routes, classes, k, t)
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return links
    held = staged(_label(large, components(links)), "jaccard-large")
    main = (held.groupBy("first", "label").agg(F.count("*").alias("m")).groupBy("first")
            .agg(F.max(F.struct("m", "label")).alias("top")).select("first", F.col("top.label").alias("main")))
    # asking sets by their own blocks, against each block of the group; a block's own pairs are answered already
    held = held.join(main, "first").withColumn("ask", F.col("label") != F.col("main"))
    asks = held.groupBy("first").agg(F.ceil(F.count_if("ask") / BLOCK).cast("int").alias("askers")).where("askers > 0")
    held = held.join(asks, "first")
    own = F.pmod(F.xxhash64("sid", F.lit(6)), F.col("askers")).cast("int")
    asking = held.where("ask").select("first", own.alias("z"), F.explode(all_of(F.col("blocks"))).alias("x"), "ask", "sid", "label", block.alias("mine"))
    asked = held.select("first", F.explode(all_of(F.col("askers"))).alias("z"), block.alias("x"), F.lit(False).alias("ask"), "sid", "label", F.lit(-1).alias("mine"))
    both = asking.where("x <> mine").unionAll(asked).drop("mine").groupBy("first", "z", "x", "sid", "label").agg(F.max("ask").alias("ask"))
    return links.unionAll(_answered(docs, both.select("first", "z", "x", "ask", "sid", "label"), classes, k, t))


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
              threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row of ``docs``.

    A text's set: its distinct shingles of ``k`` words (``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased), or its whole sequence if it has fewer words.  Texts link
    when their sets' Jaccard similarity reaches ``threshold`` (numerator,
    denominator); equal sets always do.  ``component_id``: the smallest id
    reachable by links.  Null and empty texts, and texts without words, have
    an empty set and link with nothing, so their component is their own id.
    A null id takes part but is smaller than no id; a component of null ids
    alone is null.  Repeated rows are equal texts.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = scalar(docs.agg(F.sum(F.length("text"))), 0)
    # a word takes six characters or so; a hash gets eight bits more than it takes to number all shingles
    ranges = max(1, math.ceil((chars or 0) / 6 / RANGE))
    bits = min(62, max(32, math.ceil(math.log2(chars + 2)) + 6))
    often = frequent_shingles(docs, k, ranges, bits)
    shared = docs.sparkSession.sparkContext.broadcast(often)
    entries = staged(_entries(docs, shared, k, threshold, max(1, ranges // 2), bits + 6 if bits < 56 else 62), "jaccard-entries")
    shared.unpersist()
    del often, shared
    release()
    rows = entries.where("part is null and key is null").select("doc_id", "n", "sid")
    classes = rows.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("first"))
    listed = entries.where("part is not null").select("part", "packed").groupBy("part").applyInPandas(by_group(_listed(threshold)), "key long, sid long")
    lists = staged(listed.unionAll(entries.where("key is not null").select("key", "sid")), "jaccard-lists")
    roots = components(_links(docs, lists, classes, k, threshold))
    # of every class that has links or copies: the smallest id of its component
    tied = _label(classes, roots)
    best = tied.groupBy("label").agg(F.min("first").alias("component"))
    by_set = tied.join(best, "label").select("sid", "component")
    return (rows.join(by_set, "sid", "left")
            .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))

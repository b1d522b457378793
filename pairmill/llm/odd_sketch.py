"""Near duplicates by odd sketches: MinHash samples folded into parity bitmaps.

* A text's shingle set gives ``SAMPLES`` MinHash values.  The first of them
  make ``BANDS`` band keys.  All are folded: each (number, value) flips one bit
  of ``BITS``.  Samples that two sets share flip the same bit twice, so the
  population count of the XOR of two bitmaps tells how many samples differ,
  and that most precisely where few do.
* Sets of the same band are candidates.  A band's smallest set leads it, and
  bands with the same leader are one group, so a group of near copies meets
  once and not in every band.  Only bitmaps go to the groups; a set without a
  bitmap near enough in its group is done.
* Texts of the others follow.  Pairs are taken in the order of their estimate,
  most similar first, and confirmed on the full sets, if they are not yet
  joined by links.  Links that join nothing new are not returned.
* A group of more sets than a block holds is cut into blocks; four of its sets
  go into each.  Sets that are then outside the group's largest component are
  compared with the group's other blocks, again by bitmap first.

A pair at the threshold of 0.85 shares none of 32 bands of 5 rows with a
probability of 7e-9, and its bitmaps differ in more than ``far_bits`` with one
of 1e-7; above the threshold both fall steeply.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from pairmill.session import scalar

from .common import by_group, map_arrow, staged
from .jaccard_join import components, mix, set_id, shingle_sets

SAMPLES, BITS, BANDS, ROWS = 512, 512, 32, 5
#: How far below the threshold an estimate may lie for the pair to be confirmed on the sets.
MARGIN = 0.13
#: Sets and shingles of a block at most; shingles that a task takes up together; rows of one key that share a task.
BLOCK, WEIGHT, TOGETHER, CHUNK = 1024, 4_000_000, 1_000_000, 20_000
#: Shingles of a text that are sampled at a time, and bytes of text of a slice.
STEP, BYTES = 2048, 1 << 20

_NUMBERS = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Odd factors: each orders the leading 32 bits of the shingle hashes anew.
FACTORS = (mix(_NUMBERS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of 64-bit hashes."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), STEP):
        part = h[at: at + STEP]
        for i in range(0, SAMPLES, 64):
            np.minimum(out[i: i + 64], np.multiply.outer(FACTORS[i: i + 64], part).min(axis=1), out=out[i: i + 64])
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(texts, bands) keys of (texts, samples) values."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    rows = values[:, : BANDS * ROWS].reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(key, rows.shape[:2])
    for r in range(ROWS):
        key = mix(key ^ rows[:, :, r])
    return key.astype(np.int64)


def fold(values: np.ndarray) -> np.ndarray:
    """(texts, bytes) parity bitmaps of (texts, samples) values."""
    bit = (mix(values.astype(np.uint64) + _NUMBERS) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(len(values))[:, None] * BITS).ravel(), minlength=len(values) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(values), BITS), axis=1)


def estimate(differing_bits):
    """Similarity of two sets whose bitmaps differ in so many bits."""
    share = np.minimum(2.0 * np.asarray(differing_bits) / BITS, 1 - 1e-9)
    return 1 + BITS / (4.0 * SAMPLES) * np.log(1 - share)


def far_bits(similarity: float) -> int:
    """Bits that differ at most where the estimate reaches ``similarity``."""
    return math.floor(BITS / 2 * (1 - math.exp(-4.0 * SAMPLES / BITS * (1 - similarity))))


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """Of each row of ``doc_id``, ``th``, ``text``: ``n`` and ``sid``; ``sketch`` and ``bands`` where a task meets a set first."""
    schema = (StructType().add("doc_id", docs.schema["doc_id"].dataType).add("th", "long").add("n", "long").add("sid", "long")
              .add("sketch", "binary").add("bands", ArrayType(LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _slices(batches):
            sets = shingle_sets(b.column("text").cast(pa.binary()).to_pylist(), k)
            ids = [set_id(s) if len(s) else 0 for s in sets]
            new = []
            for i, s in enumerate(sets):
                if len(s) and ids[i] not in seen:
                    seen.add(ids[i])
                    new.append(i)
            sketch: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if new:
                values = np.stack([samples(sets[i]) for i in new])
                for i, x, y in zip(new, fold(values), band_keys(values)):
                    sketch[i], bands[i] = x.tobytes(), y
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema.names)
    return map_arrow(docs.select("doc_id", "th", "text"), run, schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows, and of ``BYTES`` of text or one row."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + BYTES, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, size: str, by: str) -> DataFrame:
    """``rows`` joined with the one row of ``keyed`` for their ``key``, which ``size`` rows have.

    Rows of a key with more than ``CHUNK`` are dealt to several tasks by a hash
    of their column ``by``, and the key's row goes to each.
    """
    hot = staged(keyed.where(F.col(size) > CHUNK).select(key, F.ceil(F.col(size) / CHUNK).cast("int").alias("_chunks")), "spread-hot")
    dealt = rows.join(hot, key, "left").withColumn("_chunk", F.pmod(F.xxhash64(by), F.coalesce("_chunks", F.lit(1))).cast("int")).drop("_chunks")
    each = keyed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(size) / CHUNK), F.lit(1)).cast("int") - 1)))
    return dealt.join(each.drop(size), [key, "_chunk"]).drop("_chunk")


GROUP = ("lead", "z", "x")


def _cut(rows: pa.Table) -> Iterator[pa.Table]:
    """The rows of each (lead, z, x), each set once."""
    rows = rows.sort_by([(c, "ascending") for c in (*GROUP, "sid")])
    key = np.stack([rows.column(c).to_numpy() for c in (*GROUP, "sid")])
    fresh = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))
    rows, key = rows.filter(pa.array(fresh)), key[:3, fresh]
    start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
    for a, b in zip(start, np.append(start[1:], key.shape[1])):
        if b - a > 1:
            yield rows.slice(a, b - a)


def _near(rows: pa.Table, far: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of near bitmaps, of a row that asks and another one of another label."""
    maps = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(rows), BITS // 64)
    ask, label = rows.column("ask").to_numpy(zero_copy_only=False), rows.column("label").to_numpy()
    asking = np.flatnonzero(ask)
    for at in range(0, len(asking), 64):
        i = asking[at: at + 64]
        bits = np.zeros((len(i), len(maps)), np.uint16)
        for w in range(maps.shape[1]):
            bits += np.bitwise_count(maps[i, w][:, None] ^ maps[:, w][None, :])
        # a pair of two that ask is taken once
        ok = (bits <= far) & (label[i][:, None] != label[None, :]) & (~ask[None, :] | (i[:, None] < np.arange(len(maps))[None, :]))
        x, y = np.nonzero(ok)
        yield i[x], y, bits[x, y]


def _survivors(far: int):
    """Rows of each group that have a near bitmap there."""
    def run(rows: pa.Table) -> pa.Table:
        kept = []
        for group in _cut(rows):
            has = np.zeros(len(group), bool)
            for i, j, _ in _near(group, far):
                has[i] = has[j] = True
            if has.any():
                kept.append(group.filter(pa.array(has)))
        out = pa.concat_tables(kept) if kept else rows.slice(0, 0)
        return out.select([*GROUP, "ask", "sid", "label", "sketch"])
    return run


def _confirmed(k: int, t: tuple[int, int], far: int):
    """Links of each group that join two labels, confirmed on the full sets of the texts, the nearest bitmaps first."""
    def group(rows: pa.Table, out: list[tuple[int, int]]) -> None:
        sets = shingle_sets(rows.column("text").cast(pa.binary()).to_pylist(), k)
        sids = rows.column("sid").to_numpy()
        right = np.array([len(s) > 0 and set_id(s) == sid for s, sid in zip(sets, sids.tolist())], bool)
        label = rows.column("label").to_numpy().copy()
        found = [np.stack([i, j, bits.astype(np.int64)]) for i, j, bits in _near(rows, far)]
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0], pairs[2]))]
        for at in range(0, pairs.shape[1], 4096):
            part = pairs[:2, at: at + 4096]
            for i, j in part[:, label[part[0]] != label[part[1]]].T.tolist():
                a, b = sets[i], sets[j]
                # sizes alone rule out many pairs
                if label[i] == label[j] or not (right[i] and right[j]) or t[1] * min(len(a), len(b)) < t[0] * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if t[1] * both >= t[0] * (len(a) + len(b) - both):
                    out.append((min(int(sids[i]), int(sids[j])), max(int(sids[i]), int(sids[j]))))
                    label[label == label[j]] = label[i]

    def run(rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        for g in _cut(rows):
            group(g, out)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


MEMBERS = "lead long, z int, x int, ask boolean, sid long, label long, sketch binary"


def _answered(docs: DataFrame, routes: DataFrame, classes: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Links found in the groups of ``routes`` (``MEMBERS``): by bitmap, then on the texts of those left."""
    far = far_bits(t[0] / t[1] - MARGIN)
    bucket = lambda parts: F.pmod(F.xxhash64(*GROUP), F.lit(parts))
    maps = max(1, math.ceil(routes.count() / (8 * BLOCK)))
    near = staged(routes.withColumn("bucket", bucket(maps)).groupBy("bucket").applyInArrow(by_group(_survivors(far)), MEMBERS), "sketch-near")
    # any text of the set will do
    to = staged(near.join(classes.select("sid", "n", F.col("first").alias("_id"), F.col("th").alias("_th")), "sid"), "sketch-routes")
    parts = max(1, math.ceil(scalar(to.agg(F.sum("n")), 0) / TOGETHER))
    texts = docs.join(to, docs["doc_id"].eqNullSafe(to["_id"]) & (docs["th"] == to["_th"]))
    texts = texts.select(bucket(parts).alias("bucket"), *GROUP, "ask", "sid", "label", "sketch", "text")
    return staged(texts.groupBy("bucket").applyInArrow(by_group(_confirmed(k, t, far)), "a long, b long"), "sketch-links")


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """Links that join all sets which links between sets of a band join."""
    banded = rows.where("bands is not null")
    lists = banded.select("sid", F.explode("bands").alias("key"))
    # sids are random, so the smallest leads no matter what its text is
    leads = staged(lists.groupBy("key").agg(F.min("sid").alias("lead"), F.max("sid").alias("other"), F.count("*").alias("size"))
                   .where("lead <> other").drop("other"), "sketch-leads")
    groups = spread_join(lists, leads, "key", "size", "sid").select("lead", "sid").distinct()
    maps = banded.groupBy("sid").agg(F.any_value("sketch").alias("sketch"), F.any_value("n").alias("n"))
    members = staged(groups.join(maps, "sid"), "sketch-members")
    order = F.xxhash64("sid", F.lit(9))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / WEIGHT)).cast("int")
    sizes = staged(members.groupBy("lead").agg(
        blocks.alias("blocks"), F.count("*").alias("size"),
        F.array(F.min("sid"), F.max("sid"), F.min_by("sid", order), F.max_by("sid", order)).alias("pivots")), "sketch-sizes")
    sized = spread_join(members, sizes, "lead", "size", "sid")
    block = F.pmod(F.xxhash64("sid", F.lit(5)), F.col("blocks")).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    inside = F.when(F.array_contains("pivots", F.col("sid")), all_of(F.col("blocks"))).otherwise(F.array(block))
    routes = sized.select("lead", F.explode(inside).alias("z"), F.lit(0).alias("x"), F.lit(True).alias("ask"), "sid", F.col("sid").alias("label"), "sketch")
    links = _answered(docs, staged(routes, "sketch-blocks"), classes, k, t)
    large = sized.where("blocks > 1")
    if sizes.where("blocks > 1").isEmpty():
        return links
    roots = components(links)
    held = staged(large.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid"))
                  .select("lead", "sid", "label", "sketch", "blocks"), "sketch-large")
    main = (held.groupBy("lead", "label").agg(F.count("*").alias("m"))
            .groupBy("lead").agg(F.max_by("label", "m").alias("main"), F.sum("m").alias("size")))
    held = spread_join(held, staged(main, "sketch-main"), "lead", "size", "sid").withColumn("ask", F.col("label") != F.col("main"))
    held = staged(held, "sketch-asking")
    asks = held.groupBy("lead").agg(F.ceil(F.count_if("ask") / BLOCK).cast("int").alias("askers"), F.count("*").alias("size")).where("askers > 0")
    held = spread_join(held, staged(asks, "sketch-askers"), "lead", "size", "sid")
    own = F.pmod(F.xxhash64("sid", F.lit(6)), F.col("askers")).cast("int")
    asking = held.where("ask").select("lead", own.alias("z"), F.explode(all_of(F.col("blocks"))).alias("x"), "ask", "sid", "label", "sketch", block.alias("mine"))
    asked = held.select("lead", F.explode(all_of(F.col("askers"))).alias("z"), block.alias("x"), F.lit(False).alias("ask"), "sid", "label", "sketch")
    # a set's own block has answered already; there it is neither asked for nor twice in a group
    asking = asking.where("x <> mine").drop("mine")
    both = asking.unionByName(asked.join(asking.select("lead", "z", "x", "sid"), ["lead", "z", "x", "sid"], "left_anti"))
    more = _answered(docs, staged(both, "sketch-blocks"), classes, k, t)
    return links.unionAll(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row of ``docs``.

    A text's set: its distinct shingles of ``k`` words (``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased), or its whole sequence if it has fewer words.  Texts link
    when their sets' Jaccard similarity reaches ``threshold`` (numerator,
    denominator), confirmed on the full sets; equal sets always do.
    ``component_id``: the smallest id reachable by links.  Null and empty
    texts, and texts without words, have an empty set and link with nothing, so
    their component is their own id.  A null id takes part but is smaller than
    no id; a component of null ids alone is null.  Repeated rows are equal
    texts.  Other columns are not read.  An empty table gives no rows.

    Bands and margins are laid out for thresholds of 0.75 or more.
    """
    if threshold[0] * 4 < threshold[1] * 3:
        raise ValueError("bands would miss links below a similarity of 0.75")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    rows = staged(_sketched(docs, k), "sketch-rows")
    classes = (rows.where("n > 0").groupBy("sid")
               .agg(F.min("n").alias("n"), F.min("doc_id").alias("first"),
                    F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th"), F.count("*").alias("size")))
    classes = staged(classes, "sketch-classes")
    roots = components(_links(docs, rows, classes, k, threshold)).withColumnRenamed("node", "sid")
    roots = roots.unionByName(roots.select(F.col("root").alias("sid"), "root").distinct())
    tied = staged(classes.select("sid", "first").join(roots, "sid"), "sketch-tied")
    best = staged(tied.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size")), "sketch-best")
    by_set = spread_join(tied.select("sid", "root"), best, "root", "size", "sid").select("sid", "component")
    by_set = classes.join(by_set, "sid", "left").select("sid", F.coalesce("component", "first").alias("component"), "size")
    full = spread_join(rows.where("n > 0").select("doc_id", "n", "sid", "th"), staged(by_set, "sketch-sets"), "sid", "size", "doc_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionAll(empty)

"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed rows for the word and its first 3 to 6
bytes; a run of more than 24 bytes, as in scripts without spaces, is read as
pieces of it, one after the other.  Filters of several widths run over a text's
words, each is pooled by its maximum over the whole text, and a logistic layer
makes the score.  It learns from every labelled row: each task moves its own
copy of the model over its rows, and the copies are averaged by parameter,
several times in a pass.  A fifth of the rows sets the score's scale and a
threshold for each language instead.
Scoring is a map over the documents: the filters' products are made once for
each distinct word of a batch, so a text costs lookups and sums.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, map_arrow, regrouped, staged
from .fm_index import words_of

#: Rows of a task at least, where there are as many; averagings in a pass over all rows at most; rows of a file.
SHARD, SLICES, FILE_ROWS = 4000, 4, 1000
#: Copies of the model that one averaging sends at most (15 MB each); of more rows, tasks take more.
COPIES = 64
#: Bits of the bitmap of labelled texts for each of them, and in all at most (16 MB); bits of a row of it.
BITS, BITS_MAX, BITS_ROW = 64, 1 << 27, 1 << 15
#: Passes over all rows: as many as make ``STEPS`` rows, but so many at least and at most.
STEPS, PASSES = 24_000, (2, 6)
PREFIXES, WORD_WIDTH = (3, 4, 5, 6), 24
ROWS, DIM, WIDTHS, FILTERS = 1 << 18, 12, (1, 2, 3), 8
BATCH, RATE, DECAY, SEED = 32, 0.3, 6, 7
#: Parameters travel as rows of an embedding row and its sum of squared gradients, so many embedding rows in a block.
COLUMNS, BLOCK = DIM + 1, 1 << 12
PARAMETERS = "block int, keys binary, values binary"
#: Steps of a margin, and the largest, by which rows are counted for the scale and the thresholds.
GRID, FAR = 512, 64
#: Rows of fewer training texts stay as they are, and this share of the words is hidden at each step.
MIN_TEXTS, HIDDEN = 3, 0.4
PAD = max(WIDTHS) - 1
#: Up to ``WORD_WIDTH`` bytes that end before a character's first byte or at the end.
PIECE = re.compile(rb"(?s:.{1,%d})(?![\x80-\xBF])" % WORD_WIDTH)


def features(words: pa.Array) -> np.ndarray:
    """Embedding rows of distinct words: the word and its prefixes; row 0 where a word is shorter."""
    packed = np.array(words.to_pylist(), dtype=f"S{WORD_WIDTH}")
    letters = packed.view(np.uint8).reshape(len(words), WORD_WIDTH).astype(np.uint64)
    length = np.char.str_len(packed)
    out = np.zeros((len(words), len(PREFIXES) + 1), np.int64)
    h = np.full(len(words), 1469598103934665603, np.uint64)
    for k in range(WORD_WIDTH):
        h = np.where(k < length, (h ^ (letters[:, k] + np.uint64(1))) * np.uint64(1099511628211), h)
        if k + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(k + 1)] = np.where(length > k, _row(h, k + 1), 0)
    out[:, 0] = _row(h, 0)
    return out


def _row(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(ROWS - 1)).astype(np.int64) + 1


def _pieces(words: list[bytes]) -> list[bytes]:
    """Words longer than ``WORD_WIDTH`` bytes in pieces of that many, cut between characters; nothing is left out."""
    if all(len(w) <= WORD_WIDTH for w in words):
        return words
    return [p for w in words for p in (PIECE.findall(w) if len(w) > WORD_WIDTH else (w,))]


def encode(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the texts' word numbers (-1: padding after each text), and where each text starts."""
    words = [_pieces(words_of(t.lower().encode())) if t else [] for t in texts]
    sizes = np.array([len(w) + PAD for w in words], np.int64)
    flat = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    ids = np.full(int(sizes.sum()), -1, np.int64)
    starts = np.cumsum(sizes) - sizes
    is_word = np.ones(len(ids), bool)
    for k in range(PAD):
        is_word[starts + sizes - 1 - k] = False
    ids[is_word] = flat.indices.to_numpy(zero_copy_only=False)
    return flat.dictionary, ids, starts


@dataclass
class Model:
    rows: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def pooled(self, embedded: np.ndarray, ids: np.ndarray, starts: np.ndarray, places: bool = False):
        """Maximum of each filter over each text, at least 0; with the places of the maxima if asked for."""
        best, where = [], []
        pad = ids < 0
        for width, w, b in zip(WIDTHS, self.filters, self.biases):
            parts = np.concatenate([embedded @ w[j] for j in range(width)], 1).reshape(len(embedded), width, FILTERS)
            # a text's padding, and a word hidden in training, add nothing
            parts = np.concatenate([parts, np.zeros((2, width, FILTERS), parts.dtype)])
            z = parts[ids, 0]
            for j in range(1, width):
                z[:-j] += parts[ids[j:], j]
            z += b
            z[pad] = -np.inf
            best.append(np.maximum.reduceat(z, starts))
            if places:
                ends = np.append(starts[1:], len(ids))
                where.append(np.stack([a + z[a:e].argmax(0) for a, e in zip(starts, ends)]))
        top = np.maximum(np.concatenate(best, 1), 0)
        return (top, where) if places else top

    def margin(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        words, ids, starts = encode(texts)
        embedded = self.rows[features(words)].sum(1) if len(words) else np.zeros((0, DIM), np.float32)
        return (self.pooled(embedded, ids, starts) @ self.out + self.offset).astype(np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.margin(texts) + b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def blank(rng: np.random.Generator) -> Model:
    # nearly empty rows: a word that training never saw moves no filter
    rows = rng.normal(0, 1e-3, (ROWS, DIM)).astype(np.float32)
    rows[0] = 0
    return Model(rows, [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) / w for w in WIDTHS],
                 [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.uniform(0.2, 0.6, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)


class Learner:
    """A model in training: Adagrad on the logistic loss; only pooled places get a gradient."""

    def __init__(self, model: Model, fixed: np.ndarray):
        self.model, self.fixed = model, fixed
        self.offset = np.array([model.offset])
        self.row_sums = np.full((ROWS, 1), 1e-6, np.float32)
        self.sums = [np.full(x.shape, 1e-6, np.float32) for x in self._values()]
        self.touched = np.zeros(ROWS, bool)

    def _values(self) -> list[np.ndarray]:
        return [*self.model.filters, *self.model.biases, self.model.out, self.offset]

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values: the touched embedding rows, and all the rest under negative keys."""
        flat = np.concatenate([np.ravel(x) for x in [*self._values(), *self.sums]]).astype(np.float32)
        rest = np.pad(flat, (0, -len(flat) % COLUMNS)).reshape(-1, COLUMNS)
        rows = np.flatnonzero(self.touched)
        return (np.concatenate([rows, -1 - np.arange(len(rest))]).astype(np.int32),
                np.concatenate([np.concatenate([self.model.rows[rows], self.row_sums[rows]], 1), rest]))

    def take(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Set the given parameters."""
        row = keys >= 0
        self.model.rows[keys[row]], self.row_sums[keys[row]] = values[row, :DIM], values[row, DIM:]
        flat = values[~row][np.argsort(-keys[~row])].ravel()
        for x in [*self._values(), *self.sums]:
            x[...] = flat[:x.size].reshape(x.shape)
            flat = flat[x.size:]
        self.model.offset = float(self.offset[0])

    def step(self, texts: list[str | None], labels: np.ndarray, weight: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        m = self.model
        words, ids, starts = encode(texts)
        if not len(words):
            feats = np.zeros((0, len(PREFIXES) + 1), np.int64)
        else:
            feats = features(words)
        embedded = m.rows[feats].sum(1)
        ids = np.where((rng.random(len(ids)) < HIDDEN) & (ids >= 0), len(feats), ids)
        top, where = m.pooled(embedded, ids, starts, places=True)
        gap = ((sigmoid(top @ m.out + self.offset[0]) - labels) * weight / len(texts)).astype(np.float32)
        d_top = gap[:, None] * m.out * (top > 0)
        d_words = np.zeros_like(embedded)
        n = len(WIDTHS)
        for i, (width, w) in enumerate(zip(WIDTHS, m.filters)):
            d = d_top[:, i * FILTERS: (i + 1) * FILTERS]
            d_filter = np.zeros_like(w)
            for j in range(width):
                word = ids[np.minimum(where[i] + j, len(ids) - 1)]
                there = (word >= 0) & (word < len(feats)) & (d != 0)
                t, f = np.nonzero(there)
                at, dz = word[t, f], d[t, f]
                np.add.at(d_filter[j].T, f, embedded[at] * dz[:, None])
                np.add.at(d_words, at, w[j].T[f] * dz[:, None])
            _step(m.filters[i], d_filter, self.sums[i], rate / 4)
            _step(m.biases[i], d.sum(0), self.sums[n + i], rate / 20)
        moved = np.flatnonzero(d_words.any(1))
        touched, back = np.unique(feats[moved], return_inverse=True)
        d_rows = np.zeros((len(touched), DIM), np.float32)
        np.add.at(d_rows, back.ravel(), np.repeat(d_words[moved], feats.shape[1], 0))
        free = ~self.fixed[touched]
        touched, d_rows = touched[free], d_rows[free]
        self.touched[touched] = True
        self.row_sums[touched] += (d_rows**2).mean(1, keepdims=True)
        m.rows[touched] -= rate * d_rows / np.sqrt(self.row_sums[touched])
        _step(m.out, gap @ top, self.sums[2 * n], rate / 4)
        np.maximum(m.out, 0.01, out=m.out)
        _step(self.offset, gap.sum(keepdims=True), self.sums[2 * n + 1], rate / 4)
        m.offset = float(self.offset[0])


def _step(value: np.ndarray, gradient: np.ndarray, total: np.ndarray, rate: float) -> None:
    total += gradient**2
    value -= rate * gradient / np.sqrt(total)


def fit_scale(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, lightly held to (1, 0), by Newton's method."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    p = np.array([1.0, 0.0])
    for _ in range(30):
        q = sigmoid(x @ p)
        slope = x.T @ (weight * (q - labels)) + 0.1 * (p - [1, 0])
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
        p = p - np.linalg.solve(curve, slope)
    return (float(max(p[0], 0.05)), float(p[1]))


def best_threshold(score: np.ndarray, labels: np.ndarray, weight: np.ndarray, default: float) -> float:
    """The middle of the widest best interval by F1; the default without both labels."""
    if labels.min(initial=1) == labels.max(initial=0) or not len(labels):
        return default
    by = np.argsort(-score)
    s, hit = score[by], weight[by] * labels[by]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(weight[by]) + hit.sum())
    f1[np.append(s[1:] == s[:-1], False)] = -1
    k = int(f1.argmax())
    low = s[k + 1] if k + 1 < len(s) else 0.0
    return float(np.clip((s[k] + low) / 2, 0.05, 0.95))


def constant(share: float) -> Model:
    """The model of labels that are all alike: every score is ``share``."""
    m = blank(np.random.default_rng(SEED))
    m.rows[:] = 0
    p = min(max(share, 1e-6), 1 - 1e-6)
    m.offset, m.out = 0.0, np.zeros_like(m.out)
    m.scale = (0.0, float(np.log(p / (1 - p))))
    return m


def _blocks(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Keys and their rows of floats, a row for each block of keys that there are any of."""
    block = keys // BLOCK
    by = np.argsort(block, kind="stable")
    names, starts = np.unique(block[by], return_index=True)
    parts = np.split(by, starts[1:]) if len(names) else []
    return pa.RecordBatch.from_arrays([
        pa.array(names, pa.int32()), pa.array([keys[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
        pa.array([values[p].astype(np.float32).tobytes() for p in parts], pa.binary())], ["block", "keys", "values"])


def _sums(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of such rows, the sums of their floats, and how often each key is there."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int32)
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.float32).reshape(-1, width)
    found, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    sums = np.zeros((len(found), width))
    np.add.at(sums, at, values)
    return found, sums, times


def rare_rows(rows: DataFrame) -> np.ndarray:
    """The embedding rows that fewer than ``MIN_TEXTS`` of all the texts name, and row 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ROWS, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                words, ids, starts = encode(b.column(0).slice(lo, 200).to_pylist())
                if not len(words):
                    continue
                feats = features(words)
                for a, e in zip(starts, np.append(starts[1:], len(ids))):
                    n[np.unique(feats[np.unique(ids[a:e - PAD])])] += 1
        yield _blocks(np.flatnonzero(n), n[n > 0].astype(np.float32)[:, None])

    def often(table: pa.Table) -> pa.Table:
        keys, sums, _ = _sums(table, 1)
        keys = keys[sums[:, 0] >= MIN_TEXTS]
        return pa.Table.from_batches([_blocks(keys, np.ones((len(keys), 1), np.float32))])
    found = map_arrow(rows.select("_body"), run, PARAMETERS).groupBy("block").applyInArrow(by_group(often), PARAMETERS).toArrow()
    fixed = np.ones(ROWS, bool)
    fixed[_sums(found, 1)[0]] = False
    fixed[0] = True
    return fixed


def _moved(rows: DataFrame, learner: Learner, weight: tuple[float, float], rate: float, turn: int) -> pa.Table:
    """Parameters after a turn over ``rows``: each task moves a copy of the model, and a parameter is the mean of the copies that touched it."""
    shared = rows.sparkSession.sparkContext.broadcast(learner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, rng = None, None
        for b in regrouped(batches):
            if mine is None:
                mine = copy.deepcopy(shared.value)
                rng = np.random.default_rng([SEED, turn, TaskContext.get().partitionId()])
            y = b.column(0).to_numpy().astype(np.float64)
            w = np.where(y == 1, weight[1], weight[0])
            for part in np.array_split(np.arange(b.num_rows), max(1, b.num_rows // BATCH)):
                mine.step(b.column(1).slice(int(part[0]), len(part)).to_pylist(), y[part], w[part], rate, rng)
        if mine is not None:
            yield _blocks(*mine.parameters())

    def mean(table: pa.Table) -> pa.Table:
        keys, sums, times = _sums(table, COLUMNS)
        return pa.Table.from_batches([_blocks(keys, sums / times[:, None])])
    moved = map_arrow(rows.select("_y", "_body"), run, PARAMETERS)
    out = moved.groupBy("block").applyInArrow(by_group(mean), PARAMETERS).toArrow()  # ROWS embedding rows and a few more at most
    shared.destroy()
    return out


def train(rows: DataFrame, counts: tuple[int, int], slices: int) -> Model:
    """A model of all ``rows`` (``_slice``, ``_at``, ``_id``, ``_y``, ``_body``), of which so many have label 0 and 1; classes are weighted alike."""
    n = sum(counts)
    learner = Learner(blank(np.random.default_rng(SEED)), rare_rows(rows))
    weight = (0.5 * n / max(1, counts[0]), 0.5 * n / max(1, counts[1]))
    turns = min(max(-(-STEPS // n), PASSES[0]), PASSES[1]) * slices
    for turn in range(turns):
        # in an order that the ids alone give
        part = rows.where(F.col("_slice") == turn % slices).coalesce(min(-(-n // (slices * SHARD)), COPIES)).sortWithinPartitions("_at", "_id")
        moved = _moved(part, learner, weight, RATE / (1 + DECAY * turn / turns), turn)
        if moved.num_rows:
            learner.take(*_sums(moved, COLUMNS)[:2])
    return learner.model


def calibrate(model: Model, rows: DataFrame, share: float) -> None:
    """Set scale and thresholds by all ``rows`` (``_y``, ``_body``, ``_lang``), counted by label, language and margin in steps of 1 / ``GRID``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                at = np.rint(np.clip(shared.value.margin(part.column(2).to_pylist()), -FAR, FAR) * GRID).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at)], ["_y", "_lang", "at"])
    found = map_arrow(rows.select("_y", "_lang", "_body"), run, "_y int, _lang string, at int")
    by_lang = found.groupBy("_y", F.coalesce("_lang", F.lit("")).alias("_lang"), "at").agg(F.count("*").alias("n")).toArrow().to_pandas()
    by_lang = by_lang.sort_values(["at", "_y", "_lang"])
    y, n, lang = by_lang["_y"].to_numpy().astype(np.float64), by_lang["n"].to_numpy(), by_lang["_lang"].to_numpy()
    margin = by_lang["at"].to_numpy() / GRID
    ones = (n * y).sum() / n.sum()
    weight = n * np.where(y == 1, share / ones, (1 - share) / (1 - ones))
    model.scale = fit_scale(margin, y, weight)
    score = sigmoid(model.scale[0] * margin + model.scale[1])
    model.threshold = best_threshold(score, y, weight, 0.5)
    for x in np.unique(lang.astype(str)):
        mine = lang == x
        if n[mine & (y == 1)].sum() >= 10 and n[mine & (y == 0)].sum() >= 10:
            model.thresholds[str(x)] = best_threshold(score[mine], y[mine], weight[mine], model.threshold)
    shared.destroy()


def likely(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The ``rows`` whose ``_text`` is one of the ``n`` in ``known``, and a few others, told by a bitmap of the hashes.

    No row is sent anywhere for it, so unlabelled texts stay out of the join
    that follows, which decides.
    """
    bits = min(BITS_MAX, max(BITS_ROW, 1 << (BITS * n).bit_length()))
    at = F.pmod("_text", F.lit(bits))
    place = [F.floor(at / BITS_ROW).cast("int").alias("_row"), (at % BITS_ROW).alias("_bit")]
    bitmap = known.select(*place).repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = rows.select("*", *place).join(F.broadcast(bitmap), "_row")
    return marked.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(rows.columns)


def learn(docs: DataFrame, labels: DataFrame, allowed=None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", lang_col: str = "lang") -> Model:
    """Fit a model on all labelled documents, whole texts.

    ``allowed``: a function of the id column that tells which rows may be
    learned from.  Four fifths of the rows, by a hash of the id, train the
    model; the others set scale and thresholds; if a part lacks a label, all
    rows do both.  Rows without an id, a text or a label 0 or 1, and ids with
    both labels, are not learned from; of a repeated id one row is.  Without
    both labels every score is the share of label 1 among all labelled rows.
    """
    y = F.col(label_col)
    one = (labels.where(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
           .agg(F.min(y).alias("_y"), F.max(y).alias("_top")).where("_y = _top").select("_id", F.col("_y").cast("int").alias("_y")))
    if allowed is not None:
        one = one.where(allowed(F.col("_id")))
    given = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        given = given.where(allowed(F.col(id_col)))
    texts = given.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"))
    known = one.join(texts.groupBy("_id").agg(F.min("_text").alias("_text")), "_id")
    known = staged(known.withColumn("_rest", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(5)) == 0), "toxicity-known")
    counts = {r["_y"]: r["n"] for r in one.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    there = {(r["_rest"], r["_y"]): r["n"] for r in known.groupBy("_rest", "_y").agg(F.count("*").alias("n")).collect()}
    both = [there.get((False, k), 0) + there.get((True, k), 0) for k in (0, 1)]
    if not all(both):
        return constant(share)
    parted = len(there) == 4
    taught = (there[False, 0], there[False, 1]) if parted else (both[0], both[1])
    slices = min(SLICES, -(-sum(taught) // SHARD))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    bodies = given.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("_body"), lang.alias("_lang"))
    rows = (likely(bodies, known, sum(both))
            .join(known, ["_id", "_text"]).dropDuplicates(["_id", "_text"])
            .withColumn("_slice", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(slices)).cast("int"))
            .select("_slice", "_rest", F.xxhash64("_id", F.lit(7)).alias("_at"), "_id", "_y", "_body", "_lang"))
    rows = staged(rows, "toxicity-rows", by=["_slice", "_rest"], file_rows=FILE_ROWS)
    model = train(rows.where("not _rest") if parted else rows, taught, slices)
    calibrate(model, rows.where("_rest") if parted else rows, share)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1, from the whole text alone) and ``rejected``.

    ``rejected``: the score reaches the threshold of the row's language, or
    the general one for a null or unknown language.  Columns of these names
    are replaced.  Null and empty texts get the score of a text without words.
    """
    base = docs.drop("score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = base.columns
    schema = base.select("*", F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    text_at, lang_at = names.index(text_col), names.index(lang_col) if lang_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                s = m.score(b.column(text_at).to_pylist())
                langs = b.column(lang_at).to_pylist() if lang_at is not None else [None] * len(s)
                bound = np.array([m.thresholds.get(str(x), m.threshold) for x in langs])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(s >= bound, pa.bool_())], [*names, "score", "rejected"])
    return map_arrow(base, run, schema)

"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length 1 and turned by a random rotation; the signs are
the code, packed in words, and one correction scalar says how well the code
points along the vector.  A query's turned values are cut to a few bits, and an
inner product with a code is a sum of bit counts.  With the correction it
estimates the cosine, with a known error; candidates whose upper bound reaches
the k-th best lower bound are ranked again by the cosine of the original
vectors, in double precision.

Equal vectors are one candidate with its smallest ids, and one query, so a
vector that a third of the rows hold is one row.  Queries meet candidates in
blocks: each pair of blocks is a task's work, and only a few best of each query
leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Candidates and queries of a block, bits of a query's values, width of the error bounds, seed of the rotation.
CANDIDATES, QUERIES, PLANES, WIDTH, SEED = 4096, 1024, 6, 3.0, 20


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def unit(vectors: np.ndarray) -> np.ndarray:
    big = vectors / np.abs(vectors).max(1, keepdims=True)  # lengths of very large or small vectors stay in range
    return big / np.sqrt((big * big).sum(1, keepdims=True))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and for each the inner product of its own unit vector with the vector."""
    turned = unit(vectors) @ turn
    return _pack(turned >= 0), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, along: np.ndarray, queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries, codes) and their error bounds."""
    dims = queries.shape[1]
    turned = unit(queries) @ turn
    low, high = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
    step = np.maximum(high - low, 1e-12) / (2**PLANES - 1)
    cut = np.rint((turned - low) / step).astype(np.int64)
    inner = np.zeros((len(queries), len(codes)))
    for p in range(PLANES):
        plane = _pack((cut >> p) & 1)
        count = np.zeros(inner.shape, np.int64)
        for w in range(codes.shape[1]):
            count += np.bitwise_count(plane[:, w, None] & codes[None, :, w])
        inner += count * float(1 << p)
    ones = np.bitwise_count(codes).sum(1)
    total = (cut * step + low).sum(1, keepdims=True)
    with_code = (2 * (step * inner + low * ones) - total) / np.sqrt(dims)
    spread = np.sqrt(np.maximum(1 - along**2, 0)) / along / np.sqrt(max(dims - 1, 1))
    return with_code / along, WIDTH * (spread + step / np.sqrt(12) / along)


def search_block(queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, along: np.ndarray, k: int, turn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates ranked again, with their cosines."""
    guess, error = estimate(codes, along, queries, turn)
    sure = guess - error
    least = np.partition(sure, len(codes) - k, axis=1)[:, len(codes) - k] if len(codes) > k else np.full(len(queries), -np.inf)
    u, v = unit(queries), unit(vectors)
    out = []
    for i in range(len(queries)):
        at = np.flatnonzero(guess[i] + error[i] >= least[i])
        out.append((at, (v[at] * u[i]).sum(1)))
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` rows found nearest to each query, itself aside.

    Ties go to the smaller id; with fewer candidates than ``k``, all are
    returned.  Rows with a null id, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part.  Vectors of another
    length than a query's are not its candidates.  Of a repeated id one row
    counts, the one whose vector hashes lowest.  An empty table gives no rows.
    """
    vector = F.col(vector_col).cast("array<double>")
    good = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # -0.0 equals 0.0
    good = good.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    good = good.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    one = good.groupBy("vec_id").agg(F.min(F.struct("h1", "h2", "vector")).alias("v"), F.max("asks").alias("asks"))
    one = staged(one.select("vec_id", "asks", "v.h1", "v.h2", "v.vector"), "ann-rows")
    # of equal vectors a query needs the k smallest ids that are not its own
    first = one.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    kinds = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("vector", "vec_id").alias("vector"))
    kinds = staged(kinds.withColumn("dims", F.size("vector")), "ann-kinds")
    asked = one.where("asks").groupBy("h1", "h2").agg(F.min("vec_id").alias("_"))
    asks = staged(kinds.join(asked.drop("_"), ["h1", "h2"], "left_semi").select("h1", "h2", "dims", "vector"), "ann-queries")
    n_c, n_q = kinds.count(), asks.count()
    blocks_c, blocks_q = max(1, -(-n_c // CANDIDATES)), max(1, -(-n_q // QUERIES))
    coded = kinds.mapInArrow(_encoder, "h1 long, h2 long, ids array<long>, vector array<double>, dims int, code binary, along double")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.col("h1"), F.lit(n)).cast("int")
    left = asks.select("dims", own(blocks_q).alias("q"), each(blocks_c).alias("c"), "h1", "h2", "vector")
    right = coded.select("dims", each(blocks_q).alias("q"), own(blocks_c).alias("c"), "ids", "vector", "code", "along")
    right = right.select([F.col(c).alias(c) for c in right.columns])

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        h1, h2, ids, scores = [], [], [], []
        if len(q) and len(c):
            dims = q.column("dims")[0].as_py()
            grid = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint64).reshape(len(c), -1)
            found = search_block(grid(q), grid(c), codes, c.column("along").to_numpy(), k + 1, rotation(dims))
            members = c.column("ids").to_pylist()
            for a, b, (at, cosines) in zip(q.column("h1").to_pylist(), q.column("h2").to_pylist(), found):
                best = sorted((-s, i) for j, s in zip(at.tolist(), cosines.tolist()) for i in members[j])[: k + 1]
                h1 += [a] * len(best)
                h2 += [b] * len(best)
                ids += [i for _, i in best]
                scores += [-s for s, _ in best]
        return pa.table({"h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    key = ["dims", "q", "c"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "h1 long, h2 long, id long, score double")
    # a few rows from each block of candidates
    best = (found.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")))
            .where(F.col("place") <= k + 1).groupBy("h1", "h2").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "id")).alias("near")))
    own_best = one.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"])
    near = F.slice(F.sort_array(F.filter("near", lambda x: x["id"] != F.col("query_id"))), 1, k)
    ranked = own_best.select("query_id", F.posexplode(near).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def _encoder(batches):
    for b in batches:
        codes, along = [None] * b.num_rows, np.zeros(b.num_rows)
        dims = b.column("dims").to_numpy(zero_copy_only=False)
        vectors = b.column("vector").to_pylist()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            words, along[at] = encode(np.array([vectors[i] for i in at], np.float64).reshape(len(at), d), rotation(int(d)))
            for i, w in zip(at, words):
                codes[i] = w.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(along)], [*b.schema.names, "code", "along"])

"""Window / ranking / sampling operators.

Per-key "latest" and "first" are aggregations (``max`` of a struct), not
windows, so a hot key is pre-aggregated map-side instead of landing in one
task.  Top-k per group filters ``row_number() <= k`` with a literal k, which
Catalyst plans as a partial ``WindowGroupLimit`` before the shuffle.  Seeded
randomness is md5-based so DuckDB reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indexing import group_positions, hash_key


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def latest_per_key(df: DataFrame, keys: list[str], order_col: str, ties: str = "one",
                   tiebreak: list[str] | None = None) -> DataFrame:
    """Newest row per key by ``order_col``.

    ``ties='one'``: one row per key, ties broken by the largest ``tiebreak``
    values.  ``ties='drop'``: the reference's rule (pandas average rank must
    be exactly 1) — a key whose newest time is shared by two rows vanishes
    (X10).  Both are two partial aggregations; no window, no self-join.
    """
    tiebreak = tiebreak or []
    rest = [c for c in df.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in tiebreak], F.struct(*[F.col(c) for c in rest]).alias("__row"))
    if ties == "one":
        top = df.groupBy(*keys).agg(F.max(F.struct(F.col(order_col).alias("__o"), payload.alias("__p"))).alias("__t"))
        return top.select(*keys, "__t.__p.__row.*")
    if ties != "drop":
        raise ValueError("ties must be 'one' or 'drop'")
    g1 = df.groupBy(*keys, order_col).agg(F.count(F.lit(1)).alias("__n"), F.max(payload).alias("__p"))
    g2 = g1.groupBy(*keys).agg(F.max(F.struct(F.col(order_col).alias("__o"), "__n", "__p")).alias("__t"))
    return g2.filter(F.col("__t.__n") == 1).select(*keys, "__t.__p.__row.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key under a declared order (deterministic
    ``drop_duplicates``): ``min`` of a struct led by the order columns."""
    rest = [c for c in df.columns if c not in keys]
    t = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                                             F.struct(*[F.col(c) for c in rest]).alias("__row"))).alias("__t"))
    return t.select(*keys, "__t.__row.*")


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per group with their rank (1-based)."""
    w = Window.partitionBy(*group).orderBy(*_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """Global top-k (TakeOrderedAndProject)."""
    return df.orderBy(*_cols(order)).limit(k)


def sample_per_group(df: DataFrame, group: list[str], n: int, seed: str, id_cols: list[str]) -> DataFrame:
    """``n`` seeded random rows per group (md5 order), by
    skew-safe global-sort positions."""
    pos = group_positions(df.withColumn("__h", hash_key(seed, *id_cols)), group,
                          [F.col("__h")] + [F.col(c) for c in id_cols], pos="__r", size=None)
    return pos.filter(F.col("__r") < n).drop("__r", "__h")


def seeded_shuffle(df: DataFrame, seed: str, id_cols: list[str]) -> DataFrame:
    """O3: seeded total shuffle."""
    return df.orderBy(hash_key(seed, *id_cols), *[F.col(c) for c in id_cols])


def sample_n(df: DataFrame, n: int, seed: str, id_cols: list[str]) -> DataFrame:
    """Seeded simple random sample of ``n`` rows."""
    return seeded_shuffle(df, seed, id_cols).limit(n)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """O1: newest-first paging."""
    return df.orderBy(*_cols(order)).offset(offset).limit(limit)


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2,
                     seed: str = "42", out: str = "split") -> DataFrame:
    """Exact per-class split.  Rows are placed in seeded order inside
    their class (skew-safe global-sort positions); the first
    ceil(test_size · n_class) rows of each class are 'test'."""
    # as bytes, which sort like the text that hash_key gives
    pos = group_positions(df.withColumn("__h", F.unhex(hash_key(seed, id_col))), [label],
                          [F.col("__h"), F.col(id_col)], pos="__pos", size="__n", drop=("__h",), few=True)
    is_test = F.col("__pos") < F.ceil(F.col("__n") * F.lit(test_size))
    return pos.withColumn(out, F.when(is_test, "test").otherwise("train")).drop("__pos", "__n")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 3, seed: str = "42",
                     out: str = "fold") -> DataFrame:
    """fold = seeded in-class position mod k (class shares equal per fold)."""
    pos = group_positions(df.withColumn("__h", hash_key(seed, id_col)), [label],
                          [F.col("__h"), F.col(id_col)], pos="__pos", size=None)
    return pos.withColumn(out, (F.col("__pos") % k).cast("int")).drop("__h", "__pos")


def balanced_sample(df: DataFrame, label: str, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """At most ``n`` rows per class (seeded), stacked in seeded order."""
    s = sample_per_group(df, [label], n, seed, [id_col])
    return seeded_shuffle(s, seed + "s", [id_col])

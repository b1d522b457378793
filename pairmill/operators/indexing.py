"""Distributed positional primitives.

Pandas code in the reference leans on positional order (``rank``, ``head``,
``iloc``, ``cumcount``).  Window functions partitioned by a key put a whole
group into one task, which is unsafe when one key holds a large share of the
rows.  These helpers derive positions from a *global* range-partitioned sort
instead: a hot key is split across many tasks by the range partitioner, and
only one row per partition (the partition sizes) ever reaches the driver side
of a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

_PID, _MID, _OFF = "__pid", "__mid", "__off"


#: starts (one for each ``chunk`` rows of a group) that go to all tasks at most
FEW_STARTS = 10_000


def dense_index(df: DataFrame, order: list, name: str = "idx", reliable: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order ``order``.
    Columns ``drop`` are sorted by and then left out, before anything is written.

    ``order`` must be a total order (append a unique key as last column).  The
    sort is a range-partitioned ``orderBy``; partition sizes (one row per
    partition — bounded by the partition count) give each partition its start
    offset, broadcast back.  The sorted, tagged data is checkpointed so both
    passes see identical partitions even after an executor loss.
    """
    s = (df.orderBy(*order).drop(*drop)
           .withColumn(_PID, F.spark_partition_id())
           .withColumn(_MID, F.monotonically_increasing_id()))
    if reliable:
        s = checkpoint(s)
    sizes = s.groupBy(_PID).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PID, F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long").alias(_OFF))
    out = (s.join(F.broadcast(offsets), _PID)
             .withColumn(name, F.col(_OFF) + F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)))
    return out.drop(_PID, _MID, _OFF)


def group_positions(df: DataFrame, keys: list[str], order: list, pos: str = "pos",
                    size: str | None = "group_n", reliable: bool = True, chunk: int = 1 << 20,
                    extra: dict | None = None, drop: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Add the 0-based position of each row inside its group (``keys``) under
    ``order``, plus the group size.  Skew-safe replacement for
    ``row_number() over (partition by keys order by ...)``.

    Groups are contiguous ranges of the global index.  Each group's start is
    a partial-aggregated ``min``; it is joined back on (group, index // chunk),
    with the start row replicated once per chunk the group spans — an exact
    salt, so a group holding a third of all rows is spread over
    rows / ``chunk`` join keys instead of one.  ``extra`` = {name: aggregate
    Column} adds further per-group aggregates to every row.  Columns ``drop``
    are only sorted by.  With ``few`` groups (classes) their starts go to all
    tasks, up to ``FEW_STARTS`` of them, and the rows are not shuffled again.
    """
    idx = dense_index(df, [F.col(k) for k in keys] + list(order), "__gidx", reliable, drop) \
        .withColumn("__chunk", F.floor(F.col("__gidx") / chunk).cast("long"))
    extra = extra or {}
    starts = (idx.groupBy(*keys).agg(F.min("__gidx").alias("__gstart"), F.max("__gidx").alias("__gend"),
                                     F.count(F.lit(1)).alias("__gn"), *[c.alias(n) for n, c in extra.items()])
                 .withColumn("__chunk", F.explode(F.sequence(F.floor(F.col("__gstart") / chunk).cast("long"),
                                                             F.floor(F.col("__gend") / chunk).cast("long")))))
    if few:
        starts = checkpoint(starts)
        starts = F.broadcast(starts) if starts.count() <= FEW_STARTS else starts
    s = starts.alias("__s")
    cond = [F.col(f"__i.{k}").eqNullSafe(F.col(f"__s.{k}")) for k in keys] + \
           [F.col("__i.__chunk") == F.col("__s.__chunk")]
    out = (idx.alias("__i").join(s, cond)
              .select("__i.*", F.col("__s.__gstart"), F.col("__s.__gn"), *[F.col(f"__s.{n}") for n in extra]))
    out = out.withColumn(pos, F.col("__gidx") - F.col("__gstart"))
    if size:
        out = out.withColumn(size, F.col("__gn"))
    return out.drop("__gidx", "__gstart", "__gn", "__chunk")


def hash_unit(seed: str, *cols) -> Column:
    """Deterministic pseudo-random number in [0, 1] from md5(seed|cols).

    Written so DuckDB gives the same value:
    ``('0x' || substr(md5(seed || '|' || c), 1, 8))::BIGINT / 4294967295``.
    """
    return hash_int(seed, *cols) / F.lit(4294967295.0)


def hash_int(seed: str, *cols) -> Column:
    """32-bit unsigned integer from md5(seed|c1|c2...)."""
    key = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_key(seed: str, *cols) -> Column:
    """md5(seed|cols) as text: a seeded, engine-independent shuffle key."""
    key = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.md5(key)

"""Exact quantiles of many columns at once, without a sort.

A value's place among all doubles is a whole number of 64 bits, in the order
of the values.  Four passes narrow the ranks asked for, of all columns and
probabilities together: each pass counts rows by the next 16 bits among the
values that share the bits found so far, and the counters tell in which of
them a rank lies.  A pass sends at most 65 536 counters for each range still
open, however many rows there are; ranges that hold one value close early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .agg import unpivot

BITS, PASSES = 16, 4
ABOVE_ALL = 0x7FF0000000000001


def with_order_key(df: DataFrame, value: str, key: str = "key") -> DataFrame:
    """Adds the place of a double among all doubles: 0 for both zeros, one more for each next value; NaN comes last.

    Each step is a column of its own, which Spark computes once.
    """
    two = lambda n: F.pow(F.lit(2.0), n)
    v, names = F.col(value), ["__size", "__up", "__exp", "__half"]
    size, up, e, half = map(F.col, names)
    odd = (size == 0) | (size == float("inf")) | F.isnan(size)
    out = df.withColumn("__size", F.abs(v)).withColumn("__up", F.when(odd, 0).otherwise(F.floor(F.log2(size)).cast("int")))
    # log2 may be one off; powers of two are exact
    out = out.withColumn("__exp", F.greatest(up - (two(up) > size).cast("int") + (two(up + 1) <= size).cast("int"), F.lit(-1022)))
    # two factors, as 2 to the 1074 is no double
    out = out.withColumn("__half", F.floor((52 - e) / 2))
    place = (F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(ABOVE_ALL - 1))
             .otherwise((e + 1022).cast("long") * F.lit(1 << 52) + (size * two(half) * two(52 - e - half)).cast("long")))
    return out.withColumn(key, F.when(F.isnan(v), F.lit(ABOVE_ALL)).when(v < 0, -place).otherwise(place)).drop(*names)


def _at_ranks(long: DataFrame, asked: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Values at the ranks (from 0) of each column of (column, value, key); as many rows as ranks come to the driver."""
    spark: SparkSession = long.sparkSession
    # (column, rank) -> bits found, rank among the values that share them
    open_, found = {(c, r): (None, r) for c, ranks in asked.items() for r in ranks}, {}
    for step in range(1, PASSES + 1):
        if not open_:
            break
        shift = BITS * (PASSES - step)
        bits = F.shiftright("key", shift)
        prefix = F.lit(None).cast("long") if step == 1 else F.shiftright("key", shift + BITS)
        # ranges still open: as many rows as ranks at most
        ranges = F.broadcast(spark.createDataFrame(sorted({(c, p) for (c, _), (p, _) in open_.items()}, key=str), "c string, p long"))
        rows = long.select("column", "value", prefix.alias("prefix"), bits.alias("bits"))
        rows = rows.join(ranges, (F.col("column") == F.col("c")) & F.col("prefix").eqNullSafe(F.col("p")), "left_semi")
        counters = rows.groupBy("column", "prefix", "bits").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        # counters of one range: 65 536 at most
        through = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("bits"))
        counters = counters.select("column", "prefix", "bits", "lo", "hi", (through - F.col("n")).alias("first"), through.alias("end"))
        ranks = spark.createDataFrame([(c, p, r, rest) for (c, r), (p, rest) in open_.items()],
                                      "column string, prefix long, rank long, rest long")
        hit = counters.join(F.broadcast(ranks.withColumnRenamed("column", "c").withColumnRenamed("prefix", "p")),
                            (F.col("column") == F.col("c")) & F.col("prefix").eqNullSafe(F.col("p"))
                            & (F.col("first") <= F.col("rest")) & (F.col("rest") < F.col("end")))
        open_ = {}
        for row in hit.select("column", "rank", "bits", "lo", "hi", (F.col("rest") - F.col("first")).alias("rest")).collect():
            if row["lo"] == row["hi"] or step == PASSES:
                found[row["column"], row["rank"]] = row["lo"]
            else:
                open_[row["column"], row["rank"]] = (row["bits"], row["rest"])
    return found


def profile(df: DataFrame, cols: list[str], probs: dict[str, float]) -> DataFrame:
    """One row a column with ``count``, ``mean``, ``std``, ``min``, ``max`` and a quantile for each name in ``probs``.

    Quantiles are exact, with linear interpolation.  Nulls and what is no
    number do not count; a column without values has a count of 0 and nulls.
    NaN is the greatest value.  One pass for the moments, then at most four.
    """
    spark = df.sparkSession
    values = unpivot(df.select(*[F.col(c).try_cast("double").alias(c) for c in cols]), [], cols).where("value IS NOT NULL")
    sums = values.groupBy("column").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                        F.min("value").alias("min"), F.max("value").alias("max"))
    stats = {r["column"]: r for r in sums.collect()}  # one row a column
    places = {(c, name): p * (r["count"] - 1) for c, r in stats.items() for name, p in probs.items()}
    asked = {c: sorted({min(int(h) + d, r["count"] - 1) for (k, _), h in places.items() if k == c for d in (0, 1)}) for c, r in stats.items()}
    at = _at_ranks(with_order_key(values, "value"), asked)
    rows = []
    for c in cols:
        r = stats.get(c)
        if r is None:
            rows.append((c, 0, *[None] * (4 + len(probs))))
            continue
        qs = []
        for name in probs:
            h = places[c, name]
            lo, hi = at[c, int(h)], at[c, min(int(h) + 1, r["count"] - 1)]
            qs.append(lo if lo == hi or h == int(h) else lo + (h - int(h)) * (hi - lo))
        rows.append((c, r["count"], r["mean"], r["std"], r["min"], r["max"], *qs))
    return spark.createDataFrame(rows, "`column` string, `count` long, mean double, std double, min double, max double"
                                 + "".join(f", `{n}` double" for n in probs))

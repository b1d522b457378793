"""Aggregation operators.

Everything is a partial-aggregatable ``groupBy``/``agg`` (hot keys are
combined map-side).  Small per-column side tables (totals, min/max,
marginals) have one row per column or category value and are joined back by
key.  Exact quantiles avoid Spark's ``percentile``/``median`` aggregates,
which buffer every value of a group in one task: they read the needed
positions from running counts over the sorted distinct values instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, scalar


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "column", value: str = "value",
            cast: str | None = None) -> DataFrame:
    vals = [F.col(c).cast(cast) if cast else F.col(c) for c in cols]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias(name), v.alias(value)) for c, v in zip(cols, vals)]))
    return df.select(*ids, stacked.alias("__s")).select(*ids, f"__s.{name}", f"__s.{value}")


def value_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: value counts per column with share of non-null rows."""
    u = unpivot(df, [], cols, cast="string").filter(F.col("value").isNotNull())
    counts = u.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("__total"))
    return counts.join(totals, "column").withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3/A4: null count and share per column in one pass."""
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    u = unpivot(row, ["__n"], cols, value="n_null", cast="long")
    return u.select("column", "n_null", (F.col("n_null") / F.col("__n")).alias("share"))


def sparsity(df: DataFrame) -> DataFrame:
    """A4: null cells / all cells."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(nulls.alias("null_cells"), (F.count(F.lit(1)) * len(df.columns)).alias("cells")) \
             .withColumn("sparsity", F.col("null_cells") / F.col("cells"))


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5: rows that repeat an earlier row (whole row or by key), null-safe."""
    g = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.sum(F.col("__n") - 1).alias("n_duplicates"), F.count(F.lit(1)).alias("n_distinct"))


def rate_by_category(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Per category value: counts of positives/negatives and their
    percentages (×100); null when the class is absent (X21)."""
    u = unpivot(df, [target], cols, cast="string")
    g = u.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_if(F.col(target) == 1).alias("n_pos"),
                                          F.count_if(F.col(target) == 0).alias("n_neg"))
    return (g.withColumn("pos_pct", F.when(F.col("n_pos") > 0, F.col("n_pos") * 100.0 / F.col("n")))
             .withColumn("neg_pct", F.when(F.col("n_neg") > 0, F.col("n_neg") * 100.0 / F.col("n"))))


def right_closed_bin(x, width: float = 50000.0, n_bins: int = 20):
    """Pd.cut with right-closed bins of ``width``, lowest edge included,
    open top bin ``n_bins + 1``."""
    b = F.ceil(x / F.lit(width))
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(b, F.lit(1)), F.lit(n_bins + 1))).cast("int")


def binned_rate(df: DataFrame, col: str, target: str, width: float = 50000.0, n_bins: int = 20) -> DataFrame:
    """Counts and target rate per right-closed bin."""
    b = df.withColumn("bin", right_closed_bin(F.col(col), width, n_bins)).filter(F.col("bin").isNotNull())
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    lo = (F.col("bin") - 1) * F.lit(width)
    return g.select("bin", lo.alias("lo"),
                    F.when(F.col("bin") <= n_bins, F.col("bin") * F.lit(width)).alias("hi"), "n", "rate")


def histogram(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """A10: equal-width histogram per column (the maximum goes in the last
    bin); all bins listed, empty ones with 0."""
    u = unpivot(df, [], cols, cast="double").filter(F.col("value").isNotNull())
    mm = u.groupBy("column").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    width = (F.col("mx") - F.col("mn"))
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("mn")) * bins / width), F.lit(bins - 1))).cast("int")
    counts = u.join(F.broadcast(mm), "column").withColumn("bin", idx).groupBy("column", "bin") \
              .agg(F.count(F.lit(1)).alias("n"))
    grid = mm.select("column", "mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("mx") - F.col("mn")) / bins
    return (grid.join(counts, ["column", "bin"], "left")
                .select("column", "bin", (F.col("mn") + F.col("bin") * w).alias("lo"),
                        (F.col("mn") + (F.col("bin") + 1) * w).alias("hi"),
                        F.coalesce("n", F.lit(0)).alias("n")))


def corr_table(df: DataFrame, pairs: list[tuple[str, str]], by: str | None = None) -> DataFrame:
    """Pearson r for column pairs, overall and optionally per segment."""
    aggs = [F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs]
    overall = df.agg(*aggs).withColumn("segment", F.lit("ALL"))
    parts = [overall]
    if by:
        parts.append(df.groupBy(F.col(by).cast("string").alias("segment")).agg(*aggs))
    allp = reduce(lambda a, b: a.unionByName(b), parts)
    u = unpivot(allp, ["segment"], [f"{x}|{y}" for x, y in pairs], name="pair", value="r")
    return u.select("segment", F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "r")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square and Cramér's V of two categorical columns.

    chi² = n·(Σ_observed O² / (row·col) − 1), which only needs observed
    cells and the two marginals (no r × c grid)."""
    x = df.select(F.col(a).cast("string").alias("__a"), F.col(b).cast("string").alias("__b")) \
          .filter(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    cells = x.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy("__a").agg(F.sum("o").alias("ra"))
    cb = cells.groupBy("__b").agg(F.sum("o").alias("cb"))
    t = cells.join(ra, "__a").join(cb, "__b")
    s = t.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("__q"),
              F.sum("o").alias("n"), F.countDistinct("__a").alias("r"), F.countDistinct("__b").alias("c"))
    chi2 = F.col("n") * (F.col("__q") - 1)
    k = F.least("r", "c") - 1
    return s.select(F.lit(a).alias("x"), F.lit(b).alias("y"), "n", chi2.alias("chi2"),
                    F.when(k > 0, F.sqrt(chi2 / (F.col("n") * k))).alias("cramers_v"))


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy default, DuckDB
    ``quantile_cont``) as one row with a column per name in ``probs``; nulls
    when there is no value.

    Rows are first counted per value (partial aggregation), so a value held by
    most rows is one row of the distributed sort that follows.  Positions are
    running counts inside each range partition plus the partition's start."""
    v = df.select(F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    g = checkpoint(v.groupBy("__v").agg(F.count(F.lit(1)).alias("__c")).orderBy("__v")
                    .withColumn("__pid", F.spark_partition_id()))
    sizes = g.groupBy("__pid").agg(F.sum("__c").alias("__s"))  # one row per partition
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__pid", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    n = int(scalar(sizes.agg(F.sum("__s")), 0))
    run = Window.partitionBy("__pid").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__start") + F.sum("__c").over(run)
    x = g.join(F.broadcast(starts), "__pid").select("__v", end.alias("__end"), (end - F.col("__c")).alias("__from"))

    def at(i):
        return F.max(F.when((F.col("__from") <= i) & (F.col("__end") > i), F.col("__v")))

    out = []
    for name, p in probs.items():
        h = p * max(n - 1, 0)
        lo = int(h)
        hi = max(min(lo + 1, n - 1), 0)
        out.append((at(lo) + F.lit(float(h - lo)) * (at(hi) - at(lo))).alias(name))
    return x.agg(*out)


def interaction_density(pairs: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Interaction matrix shape, stored and non-zero entries, density.
    ``pairs`` has one row per (left, right); rows with a null id do not count."""
    known = F.col(left).isNotNull() & F.col(right).isNotNull()
    return pairs.agg(F.countDistinct(left).alias("n_rows"), F.countDistinct(right).alias("n_cols"),
                     F.count_if(known).alias("stored"),
                     F.count_if(known & (F.col(value) != 0)).alias("nonzero")) \
                .withColumn("density", F.col("nonzero") / (F.col("n_rows") * F.col("n_cols")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class 'balanced' weight n / (k · n_class), plus n_neg/n_pos."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # totals over the per-class table (one row per class)
    w = Window.partitionBy()
    t = (g.withColumn("__n", F.sum("n_class").over(w)).withColumn("__k", F.count(F.lit(1)).over(w))
          .withColumn("__neg", F.sum(F.when(F.col(label) == 0, F.col("n_class"))).over(w))
          .withColumn("__pos", F.sum(F.when(F.col(label) == 1, F.col("n_class"))).over(w)))
    return t.select(label, "n_class", (F.col("__n") / (F.col("__k") * F.col("n_class"))).alias("weight"),
                    (F.col("__neg") / F.col("__pos")).alias("scale_pos_weight"))


def score_shift(a: DataFrame, b: DataFrame, key: str, col: str, threshold: float = 0.5) -> DataFrame:
    """A25 (+ class flips): mean |Δscore| between two scorings of the same rows."""
    j = a.select(key, F.col(col).alias("__a")).join(b.select(key, F.col(col).alias("__b")), key)
    return j.agg(F.avg(F.abs(F.col("__b") - F.col("__a"))).alias("mae"),
                 F.avg(((F.col("__a") >= threshold) != (F.col("__b") >= threshold)).cast("double")).alias("flip_rate"),
                 F.count(F.lit(1)).alias("n"))


def join_one_row(a: DataFrame, one: DataFrame) -> DataFrame:
    """Put the columns of two one-row aggregates side by side without a join:
    each frame becomes one struct column, the two rows are unioned and a
    global ``max`` keeps the non-null struct of each (a constant-key join would
    be planned as a nested-loop join)."""
    sa = F.struct(*[F.col(c) for c in a.columns])
    sb = F.struct(*[F.col(c) for c in one.columns])
    ta = a.select(sa.alias("__a"))
    tb = one.select(sb.alias("__b"))
    u = (ta.select("__a", F.lit(None).cast(tb.schema["__b"].dataType).alias("__b"))
           .unionByName(tb.select(F.lit(None).cast(ta.schema["__a"].dataType).alias("__a"), "__b")))
    m = u.agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return m.select("__a.*", "__b.*")

"""Per-group ranking metrics.

NDCG positions come from the skew-safe global-sort positions (no window over
a whole group); tie averaging is a ``groupBy(group, score)`` aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import group_positions


def group_ndcg(df: DataFrame, group: str, score: str, target: str, id_col: str, min_rows: int = 2) -> DataFrame:
    """NDCG per group with sklearn's tie handling (gains of tied scores
    share the average discount of their positions); 0 when the ideal DCG is
    0; groups with fewer than ``min_rows`` rows skipped.  Binary targets:
    the ideal DCG is the sum of the first (#positives) discounts."""
    # positions and the per-group positive count come from one sort + one group aggregate
    pos = group_positions(df.select(group, score, target, id_col), [group],
                          [F.desc(score), F.asc(id_col)], pos="__pos", size="__n",
                          extra={"__npos": F.sum(target)})
    pos = pos.withColumn("__disc", 1.0 / F.log2(F.col("__pos") + 2))
    ties = pos.groupBy(group, score).agg(F.avg("__disc").alias("__ad"), F.sum(target).alias("__st"))
    dcg = ties.groupBy(group).agg(F.sum(F.col("__ad") * F.col("__st")).alias("__dcg"))
    ideal = pos.groupBy(group).agg(
        F.sum(F.when(F.col("__pos") < F.col("__npos"), F.col("__disc")).otherwise(0.0)).alias("__idcg"),
        F.max("__n").alias("n"))
    out = dcg.join(ideal, group).filter(F.col("n") >= min_rows)
    return out.select(group, "n", F.when(F.col("__idcg") > 0, F.col("__dcg") / F.col("__idcg"))
                      .otherwise(F.lit(0.0)).alias("ndcg"))


def group_prf(df: DataFrame, group: str, score: str, target: str, threshold: float = 0.5,
              min_rows: int = 2) -> DataFrame:
    """precision/recall/F1 per group at ``threshold``; zero division → 0."""
    pred = F.col(score) >= threshold
    t = F.col(target) == 1
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(pred & t).alias("tp"),
                              F.count_if(pred & ~t).alias("fp"), F.count_if(~pred & t).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    g = g.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.withColumn("f1", f1).filter(F.col("n") >= min_rows)


def error_table(df: DataFrame, score: str, target: str, threshold: float = 0.5) -> DataFrame:
    """Label every row TP / FP / FN / TN."""
    pred = F.col(score) >= threshold
    t = F.col(target) == 1
    et = F.when(pred & t, "TP").when(pred, "FP").when(t, "FN").otherwise("TN")
    return df.withColumn("error_type", et)


def top_errors(df: DataFrame, id_col: str, score: str, target: str, n: int = 10, threshold: float = 0.5) -> DataFrame:
    """N most confident FP (score desc) and FN (score asc), stacked."""
    e = error_table(df, score, target, threshold)
    fp = e.filter(F.col("error_type") == "FP").orderBy(F.desc(score), F.asc(id_col)).limit(n)
    fn = e.filter(F.col("error_type") == "FN").orderBy(F.asc(score), F.asc(id_col)).limit(n)
    from pyspark.sql import Window
    fp = fp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(id_col))))
    fn = fn.withColumn("rank", F.row_number().over(Window.orderBy(F.asc(score), F.asc(id_col))))
    return fp.unionByName(fn)


def hits_at_n(df: DataFrame, group: str, score: str, target: str, id_col: str, n: int = 10) -> DataFrame:
    """Per group, positives among the top-n and all positives."""
    from .rank import top_k_per_group
    top = top_k_per_group(df, [group], [F.desc(score), F.asc(id_col)], n)
    h = top.groupBy(group).agg(F.sum(target).alias("hits"))
    tot = df.groupBy(group).agg(F.sum(target).alias("relevant"), F.count(F.lit(1)).alias("n"))
    return tot.join(h, group, "left").withColumn("hits", F.coalesce("hits", F.lit(0))) \
              .withColumn("hit_pct", F.floor(F.col("hits") * 100 / F.lit(n)))

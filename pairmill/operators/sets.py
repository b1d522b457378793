"""Set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import explode_list_literal


def stack(*dfs: DataFrame) -> DataFrame:
    """Union all by name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row distinct."""
    return df.distinct()


def corpus_stack(a: DataFrame, a_col: str, b: DataFrame, b_col: str, out: str = "text") -> DataFrame:
    """Distinct texts of two columns stacked (a text present in both
    stays twice), tagged by origin."""
    return (a.select(F.col(a_col).alias(out)).distinct().withColumn("origin", F.lit(a_col))
             .unionAll(b.select(F.col(b_col).alias(out)).distinct().withColumn("origin", F.lit(b_col))))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: set union."""
    return a.union(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: set difference (all − loaded)."""
    return a.subtract(b)


def explode_list_column(df: DataFrame, col: str, out: str) -> DataFrame:
    """List-literal text column → one row per element (cast to bigint)."""
    return df.withColumn(out, F.explode_outer(explode_list_literal(col))).drop(col)

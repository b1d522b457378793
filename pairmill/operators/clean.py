"""Cleaning operators — column expressions composed with
``DataFrame.transform``; statistics needed by a rule (a mean) are computed
as one bounded scalar, never by pulling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.text import NDT, salary_clean
from ..session import scalar


def select_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns whose name contains ``prefix``."""
    return df.select([c for c in df.columns if prefix in c])


def prefix_rename(df: DataFrame, prefix: str, cols: list[str] | None = None) -> DataFrame:
    """P2."""
    cols = cols or df.columns
    return df.select([F.col(c).alias(prefix + c) if c in cols else F.col(c) for c in df.columns])


def drop_all_null(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows where every column of ``subset`` is null."""
    return df.dropna(how="all", subset=subset)


def drop_inconsistent(df: DataFrame, present: str, absent: list[str]) -> DataFrame:
    """P5: drop rows where ``present`` is set but all of ``absent`` are null."""
    cond = F.col(present).isNotNull()
    for c in absent:
        cond = cond & F.col(c).isNull()
    return df.filter(~cond)


def fill_strings(df: DataFrame, value: str = NDT) -> DataFrame:
    """Fill every string column with the sentinel."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.na.fill(value, subset=cols) if cols else df


def impute_mean(df: DataFrame, col: str) -> DataFrame:
    """Mean imputation (one scalar aggregate)."""
    m = scalar(df.agg(F.avg(col)))
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(m).cast("double")))


def split_numeric(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, other columns) from the schema."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return num, [c for c in df.columns if c not in num]


def outlier_filter(df: DataFrame, col: str, upper: float, keep_null: bool = True) -> DataFrame:
    """``x <= upper``; nulls kept (pandas ``~(x > upper)``) or dropped."""
    cond = F.col(col) <= upper
    return df.filter(F.coalesce(cond, F.lit(True)) if keep_null else cond)


def cap(df: DataFrame, col: str, upper: float) -> DataFrame:
    """P10: values above ``upper`` set to ``upper``; nulls stay null."""
    return df.withColumn(col, F.when(F.col(col) > upper, F.lit(upper)).otherwise(F.col(col)))


def consistency_filter(df: DataFrame, age: str, total: str, last: str, max_age: int = 90,
                       min_start_age: int = 16) -> DataFrame:
    """Drop last > total; age < total//12 + 16; age > 90.  A null
    comparison keeps the row (pandas semantics)."""
    bad1 = F.coalesce(F.col(last) > F.col(total), F.lit(False))
    bad2 = F.coalesce(F.col(age) < F.floor(F.col(total) / 12) + min_start_age, F.lit(False))
    bad3 = F.coalesce(F.col(age) > max_age, F.lit(False))
    return df.filter(~bad1 & ~bad2 & ~bad3)


def fill_clip(col: str, default: float, lo: float | None, hi: float | None):
    """fillna(default).clip(lo, hi) as a Column."""
    x = F.coalesce(F.col(col).cast("double"), F.lit(float(default)))
    if hi is not None:
        x = F.least(x, F.lit(float(hi)))
    if lo is not None:
        x = F.greatest(x, F.lit(float(lo)))
    return x


def clean_batch(df: DataFrame) -> DataFrame:
    """The batch cleaning chain (salary reset, age/experience fill+clip,
    probability features clip to [0, 1], skill count ≥ 0, last ≤ total)."""
    out = df
    cols = set(df.columns)
    if "resume_salary" in cols:
        out = out.withColumn("resume_salary", salary_clean("resume_salary"))
    if "resume_age" in cols:
        out = out.withColumn("resume_age", fill_clip("resume_age", 30.0, 18, 90))
    for c in ("resume_experience_months", "resume_last_company_experience_months"):
        if c in cols:
            out = out.withColumn(c, fill_clip(c, 0.0, 0, 720))
    for c in ("location_matching", "last_position_in_vacancy", "similarity_score_tfidf"):
        if c in cols:
            out = out.withColumn(c, fill_clip(c, 0.0, 0, 1))
    if "resume_skill_count_in_vacancy" in cols:
        out = out.withColumn("resume_skill_count_in_vacancy", fill_clip("resume_skill_count_in_vacancy", 0.0, 0, None))
    if {"resume_last_company_experience_months", "resume_experience_months"} <= cols:
        out = out.withColumn("resume_last_company_experience_months",
                             F.least("resume_last_company_experience_months", "resume_experience_months"))
    return out


def add_missing_columns(df: DataFrame, defaults: dict, order: list[str]) -> DataFrame:
    """Add absent contract columns with typed defaults, project in
    contract order."""
    out = df
    for c, v in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return out.select(*order)


def tag_reasons(df: DataFrame, rules: dict, out: str = "reasons") -> DataFrame:
    """Every row with the array of rules it breaks, in one projection;
    ``rules`` = {reason: Column that is true when the row is valid} (null: broken)."""
    return df.withColumn(out, F.array_compact(F.array(
        *[F.when(~F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()])))


def validate(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows + ``reasons`` array) by the rules of ``tag_reasons``."""
    tagged = tag_reasons(df, rules)
    return (tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0))


def regex_search(df: DataFrame, query: str, cols: list[str]) -> DataFrame:
    """P20: case-insensitive regex search over several columns (OR); null →
    no match."""
    cond = None
    for c in cols:
        hit = F.coalesce(F.col(c).rlike("(?iu)" + query), F.lit(False))
        cond = hit if cond is None else cond | hit
    return df.filter(cond)


def nan_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN → null in float columns; '' kept for strings."""
    return df.select([F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def replace_values(df: DataFrame, mapping: dict, subset: list[str]) -> DataFrame:
    """Value replacement on the given columns (e.g. 'NDT' and a
    mis-scraped status → the passive status); other values unchanged."""
    out = df
    for c in subset:
        expr = F.col(c)
        for old, new in mapping.items():
            expr = F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(expr)
        out = out.withColumn(c, expr)
    return out

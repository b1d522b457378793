"""Domain roles over the driver's tables (FIXTURES.md §B).

The reference's own data (vacancies, résumés, decisions, embeddings, logs)
is not available, so each domain entity is *derived* from the driver tables
with plain projections and equi-joins; every derivation grows with the
tables.  The same derivations are written in SQL for the DuckDB oracle
(``pairmill.plans.oracle``), so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CURRENCY_RATES
from ..operators.indexing import hash_unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vacancies(spark: SparkSession, d: str) -> DataFrame:
    """supplier ⋈ nation (area) ⋈ part with p_partkey = s_suppkey (text) ⋈
    customer with c_custkey = s_suppkey (a market-segment word in the text).

    Columns: vacancy_id, vacancy_name, vacancy_area, vacancy_description,
    vacancy_experience_raw, vacancy_employment_raw, vacancy_schedule_raw.
    """
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = (s.join(n, s.s_nationkey == n.n_nationkey, "left")
          .join(p, p.p_partkey == s.s_suppkey, "left")
          .join(c, c.c_custkey == s.s_suppkey, "left"))
    desc = F.concat_ws(" ", "s_name", "p_name", "p_type", "p_brand", "c_mktsegment",
                       F.when(F.col("p_size") % 7 == 0, F.lit("Customer care")))
    return j.select(
        F.col("s_suppkey").cast("string").alias("vacancy_id"),
        F.col("s_name").alias("vacancy_name"),
        F.col("n_name").alias("vacancy_area"),
        desc.alias("vacancy_description"),
        experience_raw_expr().alias("vacancy_experience_raw"),
        _pick(EMPLOYMENT_PHRASES, F.col("p_size")).alias("vacancy_employment_raw"),
        _pick(SCHEDULE_PHRASES, F.col("p_partkey")).alias("vacancy_schedule_raw"),
    )


# Raw category phrases as a crawler would see them; picked per row by key.
EXPERIENCE_WORDS = ["от", "более", "свыше", "не требуется", "нет"]
EMPLOYMENT_PHRASES = ["полная занятость", "Частичная занятость", "проектная работа", "разовое задание", "стажировка"]
SCHEDULE_PHRASES = ["полный день", "Удаленная работа", "гибкий график", "сменный график", "вахтовый метод", "5/2"]


def _pick(values: list[str], key: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def experience_raw_expr() -> F.Column:
    return F.concat_ws(" ", _pick(EXPERIENCE_WORDS, F.col("p_size")), (F.col("p_size") % 8).cast("string"),
                       _pick(["года", "лет"], F.col("p_partkey")))


def resume_skills_expr() -> F.Column:
    seg, brand = F.col("c_mktsegment"), F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string"))
    return (F.when(F.col("c_custkey") % 11 == 0, F.array(seg, F.lit(""), brand))
             .when(F.col("c_custkey") % 5 == 0, F.array(seg, brand, seg))
             .otherwise(F.array(seg, brand)))


def resumes(spark: SparkSession, d: str) -> DataFrame:
    """customer ⋈ nation.  Columns: resume_id, resume_location, resume_skills,
    resume_last_position, resume_salary_text, resume_acctbal, c_custkey."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        F.col("c_custkey").cast("string").alias("resume_id"),
        F.col("n_name").alias("resume_location"),
        resume_skills_expr().alias("resume_skills"),
        F.regexp_replace("c_name", "#", " ").alias("resume_last_position"),
        salary_text_expr().alias("resume_salary_text"),
        F.col("c_acctbal").alias("resume_acctbal"),
        F.col("c_custkey"),
    )


def trade_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Vacancy × résumé pairs that exist in the data: suppliers and the
    customers who bought from them (distinct (l_suppkey, o_custkey))."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # numbers are distinct before they are texts: smaller rows to shuffle
    return (li.join(o, li.l_orderkey == o.o_orderkey).select("l_suppkey", "o_custkey").distinct()
              .select(F.col("l_suppkey").cast("string").alias("vacancy_id"),
                      F.col("o_custkey").cast("string").alias("resume_id")))


def trade_sizes(spark: SparkSession, d: str) -> tuple[int, int, int]:
    """At most so many trade pairs, vacancies and résumés; counts that the files hold ready."""
    return tuple(table(spark, d, name).count() for name in ("lineitem", "supplier", "customer"))


def salary_text_expr() -> F.Column:
    """'1863 ₽'-style text from c_acctbal: currency token by c_nationkey % 10
    (index 9 = no token), every third customer written with a non-breaking
    thousands separator."""
    amt = F.floor(F.col("c_acctbal")).cast("long")
    nbsp = F.concat((amt / 1000).cast("long").cast("string"), F.lit(" "),
                    F.lpad((amt % 1000).cast("string"), 3, "0"))
    num = F.when((F.col("c_custkey") % 3 == 0) & (amt >= 1000), nbsp).otherwise(amt.cast("string"))
    cur = F.element_at(F.array(*[F.lit(sym) for sym, _ in CURRENCY_RATES] + [F.lit("")]),
                       (F.col("c_nationkey") % 10 + 1).cast("int"))
    return F.when(cur == "", num).otherwise(F.concat(num, F.lit(" "), cur))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """documents ⋈ labels as scored decisions: group = source, target =
    quality, score = md5-derived in [0, 1], plus numeric features."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(lab, "doc_id")
    return j.select(
        "doc_id", F.col("source").alias("group_id"), "lang", "n_chars", "toxic",
        F.col("quality").cast("int").alias("target"),
        F.round(hash_unit("score", "doc_id"), 6).alias("score"),
    )


def service_log(spark: SparkSession, d: str) -> DataFrame:
    """events as the prediction-history log."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("resume_id"), F.col("event_type"),
        F.col("value").alias("processing_time"),
        (F.col("event_type") == "purchase").cast("int").alias("prediction"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """events as entity snapshots: id = user_id, source = event_type,
    parsed_date = ts truncated to the day (creates ties, X10)."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("source"),
        F.date_trunc("day", "ts").alias("parsed_date"), F.col("event_id"), F.col("value"), F.col("ts"),
    )


def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    """customer as numeric résumé fields with derived nulls and outliers
    (salary up to 1.5e7 and negative, ages 16..95, months up to 899)."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("resume_id"),
        (F.col("c_acctbal") * 1500).alias("resume_salary"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(16 + k % 80).cast("double").alias("resume_age"),
        F.when(k % 11 == 0, F.lit(None)).otherwise((k * 7) % 900).cast("double").alias("resume_experience_months"),
        F.when(k % 13 == 0, F.lit(None)).otherwise((k * 13) % 800).cast("double")
         .alias("resume_last_company_experience_months"),
        F.col("c_mktsegment").alias("segment"),
    )


def period_texts(spark: SparkSession, d: str) -> DataFrame:
    """part as experience-period texts: '<size> год|года|лет <key % 12> месяцев',
    'нет' for every 13th part."""
    p = table(spark, d, "part")
    unit = (F.when(F.col("p_size") % 10 == 1, " год ")
             .when((F.col("p_size") % 10).isin(2, 3, 4), " года ").otherwise(" лет "))
    txt = F.concat(F.col("p_size").cast("string"), unit, (F.col("p_partkey") % 12).cast("string"), F.lit(" месяцев"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 13 == 0, F.lit("нет")).otherwise(txt).alias("period_text"))

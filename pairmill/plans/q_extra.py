"""Registered queries, second batch: training-set builder, ranking and
sampling helpers, EDA reports, validation/search filters, vacancy text
parsing (salary ranges, dates), pages' main text, vector pooling, ROC AUC."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import l2_normalize, mean_pool, sparsify
from ..operators import agg as A
from ..operators import clean as C
from ..operators import rank as RK
from ..operators.joins import anti_join, negative_pairs
from ..operators.metrics import hits_at_n
from ..session import checkpoint, scalar
from ..sources import roles
from . import oracle_roles as R
from .catalog import register
from .q_core import NEG_SQL

r6 = lambda c: F.round(c, 6)


# ---------------------------------------------------------------- M19 training set

@register("training_set", f"""
WITH neg AS ({NEG_SQL}), tp AS ({R.TRADE_PAIRS}), v AS ({R.VACANCIES}), r AS ({R.RESUMES}),
u AS (SELECT vacancy_id, resume_id, 1 AS target FROM tp UNION ALL SELECT vacancy_id, resume_id, target FROM neg)
SELECT u.vacancy_id, u.resume_id, u.target, v.vacancy_area, r.resume_location,
       CASE WHEN v.vacancy_area = r.resume_location THEN 1 ELSE 0 END AS location_matching
FROM u JOIN v ON u.vacancy_id = v.vacancy_id JOIN r ON u.resume_id = r.resume_id
""")
def q_training_set(spark, d):
    """Positives (observed pairs, inner join — X11) plus 90
    seeded negatives per vacancy, stacked and enriched from both sides."""
    vac = roles.vacancies(spark, d)
    res = roles.resumes(spark, d)
    tp = checkpoint(roles.trade_pairs(spark, d))  # the positives, and what negatives are not
    pos = tp.withColumn("target", F.lit(1))
    neg = negative_pairs(vac.select("vacancy_id"), res.select("resume_id"), tp, 90, "vacancy_id", "resume_id", seed="42")
    u = pos.unionByName(neg)
    j = u.join(vac.select("vacancy_id", "vacancy_area"), "vacancy_id").join(
        res.select("resume_id", "resume_location"), "resume_id")
    return j.select("vacancy_id", "resume_id", "target", "vacancy_area", "resume_location",
                    T.location_match("vacancy_area", "resume_location").alias("location_matching"))


# ---------------------------------------------------------------- W2, W3/W5, W12, W15

@register("first_per_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1
""")
def q_first_per_key(spark, d):
    """First line per order under a declared order (deterministic
    drop_duplicates)."""
    li = roles.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return RK.first_per_key(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"]) \
             .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("global_top10", """
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice,
       CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
FROM orders QUALIFY rank <= 10
""")
def q_global_top10(spark, d):
    """Global top-10 by value with a rank number."""
    o = roles.table(spark, d, "orders")
    top = RK.top_k(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))  # over 10 rows
    return top.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"), F.row_number().over(w).alias("rank"))


@register("hits_at_n", f"""
WITH s AS ({R.DECISIONS}),
t AS (SELECT group_id, sum(target) AS hits FROM (
        SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn <= 10
      GROUP BY group_id),
g AS (SELECT group_id, sum(target) AS relevant, count(*) AS n FROM s GROUP BY group_id)
SELECT g.group_id, CAST(g.relevant AS BIGINT) AS relevant, g.n, CAST(coalesce(t.hits, 0) AS BIGINT) AS hits, CAST(floor(coalesce(t.hits, 0) * 100 / 10) AS BIGINT) AS hit_pct
FROM g LEFT JOIN t ON g.group_id = t.group_id
""")
def q_hits_at_n(spark, d):
    """Positives among each group's top-10 and all positives."""
    h = hits_at_n(roles.decisions(spark, d), "group_id", "score", "target", "doc_id", 10)
    return h.select("group_id", "relevant", "n", "hits", F.col("hit_pct").cast("long").alias("hit_pct"))


@register("score_classes", f"""
WITH s AS ({R.DECISIONS})
SELECT CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'mid' ELSE 'low' END AS score_class,
       count(*) AS n, count(*) FILTER (WHERE target = 1) AS n_pos
FROM s GROUP BY 1
""")
def q_score_classes(spark, d):
    """Thresholds → class labels (0.75 / 0.5)."""
    s = roles.decisions(spark, d).withColumn("score_class", T.score_class("score"))
    return s.groupBy("score_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") == 1).alias("n_pos"))


# ---------------------------------------------------------------- A9, A17/A27, A20, A22, A23, A28, A29

@register("describe_numeric", """
SELECT 'c_acctbal' AS "column", count(c_acctbal) AS count, round(avg(c_acctbal), 6) AS mean,
       round(stddev_samp(c_acctbal), 6) AS std, round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max
FROM customer
UNION ALL
SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 6), round(stddev_samp(c_nationkey), 6),
       round(min(c_nationkey), 6), round(max(c_nationkey), 6) FROM customer
""")
def q_describe_numeric(spark, d):
    """A9 (numeric part): count, mean, std, min, max per column."""
    c = roles.table(spark, d, "customer")
    parts = [c.agg(F.lit(x).alias("column"), F.count(x).alias("count"), r6(F.avg(x)).alias("mean"),
                   r6(F.stddev_samp(x)).alias("std"), r6(F.min(F.col(x).cast("double"))).alias("min"),
                   r6(F.max(F.col(x).cast("double"))).alias("max")) for x in ("c_acctbal", "c_nationkey")]
    return parts[0].unionByName(parts[1])


@register("describe_categorical", """
WITH f AS (SELECT c_mktsegment AS v, count(*) AS freq FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT 'c_mktsegment' AS "column", (SELECT count(c_mktsegment) FROM customer) AS count,
       (SELECT count(DISTINCT c_mktsegment) FROM customer) AS "unique",
       (SELECT v FROM f ORDER BY freq DESC, v DESC LIMIT 1) AS top,
       (SELECT freq FROM f ORDER BY freq DESC, v DESC LIMIT 1) AS freq
""")
def q_describe_categorical(spark, d):
    """A9 (object part): count, unique, top value and its frequency."""
    c = roles.table(spark, d, "customer")
    base = c.agg(F.count("c_mktsegment").alias("count"), F.countDistinct("c_mktsegment").alias("unique"))
    top = (c.filter(F.col("c_mktsegment").isNotNull()).groupBy(F.col("c_mktsegment").alias("top"))
            .agg(F.count(F.lit(1)).alias("freq")).agg(F.max(F.struct("freq", "top")).alias("__t"))
            .select("__t.top", "__t.freq"))
    return A.join_one_row(base, top).select(F.lit("c_mktsegment").alias("column"), "count", "unique", "top", "freq")


@register("distinct_terms", """
SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F'
""")
def q_distinct_terms(spark, d):
    """Distinct values of one column under a condition on another."""
    o = roles.table(spark, d, "orders")
    return o.filter(F.col("o_orderstatus") == "F").select("o_orderpriority").distinct()


@register("interaction_density", """
WITH p AS (SELECT o.o_custkey AS u, l.l_partkey AS i, sum(l.l_quantity) AS v
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)
SELECT count(DISTINCT u) AS n_rows, count(DISTINCT i) AS n_cols, count(*) AS stored,
       count(*) FILTER (WHERE v <> 0) AS nonzero,
       round(count(*) FILTER (WHERE v <> 0) / (count(DISTINCT u) * count(DISTINCT i)), 6) AS density
FROM p
""")
def q_interaction_density(spark, d):
    """Interaction matrix shape, stored / non-zero entries, density."""
    li = roles.table(spark, d, "lineitem")
    o = roles.table(spark, d, "orders")
    p = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"))
           .agg(F.sum("l_quantity").alias("v")))
    return A.interaction_density(p, "u", "i", "v").withColumn("density", r6("density"))


@register("header_metrics", f"""
WITH s AS ({R.DECISIONS})
SELECT group_id, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM s GROUP BY group_id
""")
def q_header_metrics(spark, d):
    """Result-list header metrics (count, best and mean score)."""
    s = roles.decisions(spark, d)
    return s.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("score")).alias("best"),
                                     r6(F.avg("score")).alias("mean"))


@register("ingest_report", """
SELECT o_orderpriority AS search_query, count(*) AS n, count(DISTINCT o_custkey) AS n_unique FROM orders GROUP BY 1
UNION ALL SELECT 'ALL', count(*), count(DISTINCT o_custkey) FROM orders
""")
def q_ingest_report(spark, d):
    """Rows and unique ids, per search term and overall."""
    o = roles.table(spark, d, "orders")
    per = o.groupBy(F.col("o_orderpriority").alias("search_query")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_unique"))
    tot = o.agg(F.lit("ALL").alias("search_query"), F.count(F.lit(1)).alias("n"),
                F.countDistinct("o_custkey").alias("n_unique"))
    return per.unionByName(tot)


@register("cold_start_coverage", """
WITH tp AS (SELECT DISTINCT l.l_suppkey AS v, o.o_custkey AS r FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
k AS (SELECT tp.*, a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL AS known
      FROM tp LEFT JOIN embeddings a ON a.vec_id = tp.v LEFT JOIN embeddings b ON b.vec_id = tp.r)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE known) AS n_known, count(*) FILTER (WHERE NOT known) AS n_zero,
       round(count(*) FILTER (WHERE known) / count(*), 6) AS coverage
FROM k
""")
def q_cold_start_coverage(spark, d):
    """Pairs whose both sides have a vector vs those scored 0 by default."""
    tp = roles.trade_pairs(spark, d)
    e = roles.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("k"), F.lit(True).alias("h"))
    j = (tp.join(e.toDF("vacancy_id", "hv"), "vacancy_id", "left").join(e.toDF("resume_id", "hr"), "resume_id", "left"))
    known = F.col("hv").isNotNull() & F.col("hr").isNotNull()
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(known).alias("n_known"),
                 F.count_if(~known).alias("n_zero"), r6(F.count_if(known) / F.count(F.lit(1))).alias("coverage"))


@register("cleaning_step_counts", f"""
WITH n AS ({R.NUMERIC_PROFILE})
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE resume_age IS NULL) AS n_age_imputed,
       count(*) FILTER (WHERE resume_salary > 10000000) AS n_salary_outliers,
       count(*) FILTER (WHERE resume_experience_months > 720) AS n_capped,
       count(*) FILTER (WHERE resume_last_company_experience_months > resume_experience_months) AS n_last_gt_total,
       count(*) FILTER (WHERE resume_age < floor(resume_experience_months / 12) + 16) AS n_too_young,
       count(*) FILTER (WHERE resume_age > 90) AS n_too_old
FROM n
""")
def q_cleaning_step_counts(spark, d):
    """Rows hit by each cleaning rule, one pass."""
    n = roles.numeric_profile(spark, d)
    age, tot, last = F.col("resume_age"), F.col("resume_experience_months"), F.col("resume_last_company_experience_months")
    return n.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(age.isNull()).alias("n_age_imputed"),
                 F.count_if(F.col("resume_salary") > 1e7).alias("n_salary_outliers"),
                 F.count_if(tot > 720).alias("n_capped"), F.count_if(last > tot).alias("n_last_gt_total"),
                 F.count_if(age < F.floor(tot / 12) + 16).alias("n_too_young"), F.count_if(age > 90).alias("n_too_old"))


# ---------------------------------------------------------------- J8/U4, P4-P8, P18, P20, P21

@register("work_list", """
SELECT n_name FROM nation
WHERE n_name NOT IN (SELECT DISTINCT n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                     WHERE s.s_acctbal > 5000)
""")
def q_work_list(spark, d):
    """Search terms not yet loaded (all nations minus those with a
    loaded supplier batch), sorted."""
    n = roles.table(spark, d, "nation")
    s = roles.table(spark, d, "supplier").filter(F.col("s_acctbal") > 5000)
    loaded = s.join(n, s.s_nationkey == n.n_nationkey).select("n_name").distinct()
    return anti_join(n.select("n_name").distinct(), loaded, ["n_name"]).orderBy("n_name")


@register("null_filters", f"""
WITH n AS ({R.NUMERIC_PROFILE}),
a AS (SELECT * FROM n WHERE NOT (resume_age IS NULL AND resume_experience_months IS NULL
                                 AND resume_last_company_experience_months IS NULL)),
b AS (SELECT * FROM a WHERE NOT (resume_age IS NOT NULL AND resume_experience_months IS NULL
                                 AND resume_last_company_experience_months IS NULL))
SELECT resume_id, coalesce(segment, 'NDT') AS segment, coalesce(resume_age, 0.0) AS resume_age,
       coalesce(resume_experience_months, 0.0) AS resume_experience_months,
       coalesce(resume_last_company_experience_months, 0.0) AS resume_last_company_experience_months
FROM b
""")
def q_null_filters(spark, d):
    """P4 (all-null subset), P5 (inconsistent pattern), P6 ('NDT' strings),
    P8 (zero fill)."""
    n = roles.numeric_profile(spark, d).drop("resume_salary")
    sub = ["resume_age", "resume_experience_months", "resume_last_company_experience_months"]
    x = C.drop_all_null(n, sub)
    x = C.drop_inconsistent(x, "resume_age", sub[1:])
    x = C.fill_strings(x).na.fill(0.0, subset=sub)
    return x.select("resume_id", "segment", *sub)


_CYR = r"^[а-яА-ЯёЁ\s\-()]+$"


@register("validate_rows", f"""
WITH v AS ({R.VACANCIES})
SELECT vacancy_id, len(reasons) = 0 AS is_valid, reasons FROM (
  SELECT vacancy_id, list_filter([
      CASE WHEN NOT coalesce(regexp_full_match(vacancy_area, '[а-яА-ЯёЁ\\s\\-()]+'), false) THEN 'area_not_cyrillic' END,
      CASE WHEN NOT coalesce(trim(vacancy_description) <> '', false) THEN 'description_blank' END,
      CASE WHEN NOT coalesce(vacancy_schedule_raw IN ('Полный день', 'Удаленная работа', 'Гибкий график',
                                                       'Сменный график', 'Вахтовый метод'), false)
           THEN 'schedule_not_in_domain' END], lambda x: x IS NOT NULL) AS reasons
  FROM v)
""")
def q_validate_rows(spark, d):
    """Row validation with an array of failure reasons."""
    v = roles.vacancies(spark, d)
    rules = {"area_not_cyrillic": F.col("vacancy_area").rlike(_CYR),
             "description_blank": F.trim("vacancy_description") != "",
             "schedule_not_in_domain": F.col("vacancy_schedule_raw").isin(*T.SCHEDULE_OPTIONS)}
    ok, bad = C.validate(v, rules)
    return (ok.select("vacancy_id", F.lit(True).alias("is_valid"), F.array().cast("array<string>").alias("reasons"))
              .unionByName(bad.select("vacancy_id", F.lit(False).alias("is_valid"), "reasons")))


@register("regex_search", """
SELECT vacancy_id FROM (SELECT CAST(s.s_suppkey AS VARCHAR) AS vacancy_id, s.s_name AS a,
                               concat_ws(' ', s.s_name, p.p_name, p.p_type, p.p_brand) AS b
                        FROM supplier s LEFT JOIN part p ON p.p_partkey = s.s_suppkey)
WHERE coalesce(regexp_matches(a, '(?i)brand#1[0-9]'), false) OR coalesce(regexp_matches(b, '(?i)brand#1[0-9]'), false)
""")
def q_regex_search(spark, d):
    """P20: case-insensitive regex search over two columns (OR, null → no)."""
    s = roles.table(spark, d, "supplier")
    p = roles.table(spark, d, "part")
    v = s.join(p, p.p_partkey == s.s_suppkey, "left").select(
        F.col("s_suppkey").cast("string").alias("vacancy_id"), F.col("s_name").alias("a"),
        F.concat_ws(" ", "s_name", "p_name", "p_type", "p_brand").alias("b"))
    return C.regex_search(v, "brand#1[0-9]", ["a", "b"]).select("vacancy_id")


@register("newest_nonnull", f"""
WITH s AS ({R.SERVICE_LOG})
SELECT id, created_at FROM s WHERE k IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 2000
""")
def q_newest_nonnull(spark, d):
    """Non-null filter + newest 2 000 (a top-N report)."""
    s = roles.service_log(spark, d).filter(F.col("k").isNotNull())
    return RK.top_k(s, [F.desc("created_at"), F.desc("id")], 2000).select("id", "created_at")


# ---------------------------------------------------------------- F3/F4/F5 salary ranges

def _fmt_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 1000 THEN CAST({x} // 1000 AS VARCHAR) || ' ' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0') "
            f"ELSE CAST({x} AS VARCHAR) END")


_SAL_TEXT_SQL = f"""
  SELECT p_partkey, CASE p_partkey % 5
      WHEN 0 THEN 'от ' || {_fmt_sql('a')} || ' до ' || {_fmt_sql('b')} || ' ₽ на руки'
      WHEN 1 THEN 'до ' || {_fmt_sql('b')} || ' руб. до вычета налогов'
      WHEN 2 THEN {_fmt_sql('a')} || ' – ' || {_fmt_sql('b')} || ' $'
      WHEN 3 THEN 'от ' || {_fmt_sql('a')} || ' €'
      ELSE {_fmt_sql('a')} END AS salary_text
  FROM (SELECT p_partkey, CAST(p_retailprice * 100 AS BIGINT) AS a,
               CAST(p_retailprice * 100 AS BIGINT) + p_size * 1000 AS b FROM part)
"""


def _fmt(x):
    return F.when(x >= 1000, F.concat((x / 1000).cast("long").cast("string"), F.lit(" "),
                                      F.lpad((x % 1000).cast("string"), 3, "0"))).otherwise(x.cast("string"))


def _salary_texts(spark, d):
    p = roles.table(spark, d, "part")
    a = (F.col("p_retailprice") * 100).cast("long")
    b = a + F.col("p_size") * 1000
    k = F.col("p_partkey") % 5
    txt = (F.when(k == 0, F.concat(F.lit("от "), _fmt(a), F.lit(" до "), _fmt(b), F.lit(" ₽ на руки")))
            .when(k == 1, F.concat(F.lit("до "), _fmt(b), F.lit(" руб. до вычета налогов")))
            .when(k == 2, F.concat(_fmt(a), F.lit(" – "), _fmt(b), F.lit(" $")))
            .when(k == 3, F.concat(F.lit("от "), _fmt(a), F.lit(" €")))
            .otherwise(_fmt(a)))
    return p.select("p_partkey", txt.alias("salary_text"))


def _cur_sql(t):
    return (f"CASE WHEN contains({t}, '₽') OR contains(lower({t}), 'руб') THEN 'RUR' "
            f"WHEN contains({t}, '$') OR contains({t}, 'USD') THEN 'USD' "
            f"WHEN contains({t}, '€') OR contains({t}, 'EUR') THEN 'EUR' END")


@register("salary_range", f"""
WITH s AS ({_SAL_TEXT_SQL}),
x AS (SELECT p_partkey, salary_text AS t, lower(salary_text) AS lo,
             list_transform(regexp_extract_all(salary_text, '\\d[\\d\\s]*\\d|\\d'),
                            lambda z: CAST(regexp_replace(z, '\\s', '', 'g') AS DOUBLE)) AS na,
             list_transform(regexp_extract_all(regexp_replace(salary_text, '(\\d)\\s+(\\d)', '\\1\\2', 'g'), '\\d{{4,}}'),
                            lambda z: CAST(z AS DOUBLE)) AS nb
      FROM s)
SELECT p_partkey, t AS salary_text,
  CASE WHEN contains(lo, 'от') AND contains(lo, 'до') AND len(na) >= 2 THEN na[1]
       WHEN contains(lo, 'от') AND len(na) >= 1 THEN na[1]
       WHEN contains(lo, 'до') AND len(na) >= 1 THEN NULL
       WHEN len(na) >= 1 THEN na[1] END AS a_from,
  CASE WHEN contains(lo, 'от') AND contains(lo, 'до') AND len(na) >= 2 THEN na[2]
       WHEN contains(lo, 'от') AND len(na) >= 1 THEN NULL
       WHEN contains(lo, 'до') AND len(na) >= 1 THEN na[1] END AS a_to,
  {_cur_sql('t')} AS currency,
  CASE WHEN contains(lo, 'до вычета') OR contains(lo, 'gross') THEN true WHEN contains(lo, 'на руки') THEN false END AS gross,
  CASE WHEN contains(lo, 'до') AND NOT contains(lo, 'от') AND len(nb) >= 1 THEN NULL
       WHEN contains(lo, 'от') AND len(nb) >= 1 THEN nb[1]
       WHEN (contains(t, '—') OR contains(t, '–') OR contains(t, '-')) AND len(nb) >= 1 THEN nb[1]
       WHEN len(nb) >= 1 THEN nb[1] END AS b_from,
  CASE WHEN contains(lo, 'до') AND NOT contains(lo, 'от') AND len(nb) >= 1 THEN nb[1]
       WHEN contains(lo, 'от') AND len(nb) >= 2 THEN nb[2]
       WHEN contains(lo, 'от') THEN NULL
       WHEN (contains(t, '—') OR contains(t, '–') OR contains(t, '-')) AND len(nb) >= 2 THEN nb[2] END AS b_to
FROM x
""")
def q_salary_range(spark, d):
    """vacancy salary range (two parser variants) and gross flag
    from salary texts built per part."""
    s = _salary_texts(spark, d)
    a = T.salary_range_a("salary_text")
    b = T.salary_range_b("salary_text")
    return s.select("p_partkey", "salary_text", a["salary_from"].alias("a_from"), a["salary_to"].alias("a_to"),
                    a["salary_currency"].alias("currency"), T.salary_gross("salary_text").alias("gross"),
                    b["salary_from"].alias("b_from"), b["salary_to"].alias("b_to"))


# ---------------------------------------------------------------- F23/F24 dates

_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in T.RU_MONTHS) + "]"


@register("russian_dates", f"""
WITH o AS (SELECT o_orderkey, o_orderdate, (SELECT max(o_orderdate) FROM orders) AS as_of,
                  CAST(day(o_orderdate) AS VARCHAR) AS dd, ({_MONTHS_SQL})[month(o_orderdate)] AS mm,
                  CAST(year(o_orderdate) AS VARCHAR) AS yy FROM orders),
t AS (SELECT o_orderkey, as_of, CASE o_orderkey % 5
        WHEN 0 THEN 'Сегодня в 09:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
        WHEN 1 THEN 'Вчера'
        WHEN 2 THEN CASE WHEN o_orderkey % 7 = 0 THEN '31' ELSE dd END || ' ' || mm
        WHEN 3 THEN dd || ' ' || mm || ' ' || yy
        ELSE 'опубликована' || dd || ' ' || mm || ' ' || yy END AS date_text FROM o),
x AS (SELECT *, regexp_extract(date_text, '(?i)опубликована\\s*(\\d{{1,2}})\\s*(' || array_to_string({_MONTHS_SQL}, '|') || ')\\s*(\\d{{4}})', ['d', 'm', 'y']) AS p1,
             regexp_extract(date_text, '(?i)(\\d{{1,2}})\\s+(' || array_to_string({_MONTHS_SQL}, '|') || ')(?:\\s+(\\d{{4}}))?', ['d', 'm', 'y']) AS p2,
             regexp_extract(date_text, '[Сс]егодня(?:\\s+в\\s+(\\d{{1,2}}:\\d{{2}}))?', 1) AS hm FROM t)
SELECT o_orderkey, date_text,
  CASE WHEN p1.d <> '' THEN try_strptime(p1.y || '-' || lpad(CAST(list_position({_MONTHS_SQL}, lower(p1.m)) AS VARCHAR), 2, '0')
                                         || '-' || lpad(p1.d, 2, '0'), '%Y-%m-%d') END AS published_at,
  CASE WHEN regexp_matches(date_text, '[Сс]егодня') THEN
         CASE WHEN hm <> '' THEN try_strptime(strftime(as_of, '%Y-%m-%d') || ' ' || lpad(hm, 5, '0') || ':00', '%Y-%m-%d %H:%M:%S')
              ELSE as_of END
       WHEN regexp_matches(date_text, '[Вв]чера') THEN as_of - INTERVAL 1 DAY
       WHEN p2.d <> '' THEN try_strptime(
            CASE WHEN p2.y <> '' THEN p2.y ELSE CAST(year(as_of) - CASE WHEN list_position({_MONTHS_SQL}, lower(p2.m)) > month(as_of) THEN 1 ELSE 0 END AS VARCHAR) END
            || '-' || lpad(CAST(list_position({_MONTHS_SQL}, lower(p2.m)) AS VARCHAR), 2, '0') || '-' || lpad(p2.d, 2, '0'), '%Y-%m-%d')
  END AS parsed_at
FROM x
""")
def q_russian_dates(spark, d):
    """absolute ('опубликована 1 мая 2026') and relative ('Сегодня в
    hh:mm', 'Вчера', 'd месяца [yyyy]') dates; ``as_of`` = newest order date."""
    o = roles.table(spark, d, "orders")
    as_of = scalar(o.agg(F.max("o_orderdate")))
    mm = F.element_at(F.array(*[F.lit(m) for m in T.RU_MONTHS]), F.month("o_orderdate"))
    dd, yy = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 5
    txt = (F.when(k == 0, F.concat(F.lit("Сегодня в 09:"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")))
            .when(k == 1, F.lit("Вчера"))
            .when(k == 2, F.concat(F.when(F.col("o_orderkey") % 7 == 0, F.lit("31")).otherwise(dd), F.lit(" "), mm))
            .when(k == 3, F.concat_ws(" ", dd, mm, yy))
            .otherwise(F.concat(F.lit("опубликована"), dd, F.lit(" "), mm, F.lit(" "), yy)))
    t = o.select("o_orderkey", txt.alias("date_text"))
    return t.select("o_orderkey", "date_text", T.published_date("date_text").alias("published_at"),
                    T.relative_date("date_text", F.lit(as_of).cast("timestamp")).alias("parsed_at"))


# ---------------------------------------------------------------- F29 pages' main text

@register("page_main_text", """
WITH c AS (SELECT page_id, html, regexp_replace(html,
       '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script[^>]*>|<style\\b[^>]*>.*?</style[^>]*>', '', 'g') AS h FROM pages),
p AS (SELECT page_id, html, string_split(regexp_replace(h, '(?i)(</?(?:p|div|section)\\b)', chr(1) || '\\1', 'g'), chr(1)) AS s
      FROM c),
l AS (SELECT page_id, html, list_transform(
        list_filter(range(1, len(s)), lambda i: regexp_matches(s[i], '(?i)^<(?:p|div|section)\\b')
          AND regexp_matches(s[i + 1], '(?i)^</') AND lower(regexp_extract(s[i], '^<([a-zA-Z]+)', 1)) =
              lower(regexp_extract(s[i + 1], '^</([a-zA-Z]+)', 1))),
        lambda i: regexp_replace(regexp_replace(regexp_replace(s[i], '^<[^>]*>', ''),
          '[ \\t\\r\\n\\f]*<[^>]*>[ \\t\\r\\n\\f]*', '', 'g'), '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')) AS b FROM p),
t AS (SELECT page_id, html, nullif(list_reduce(list_prepend('', b),
        lambda acc, x: CASE WHEN length(x) > length(acc) THEN x ELSE acc END), '') AS best FROM l)
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       CAST(length(best) AS INTEGER) AS main_chars,
       CASE WHEN length(best) > 80 THEN substr(best, 1, 80) || '...' ELSE best END AS main_preview
FROM t
""")
def q_page_main_text(spark, d):
    """main text of each page = longest leaf block (inner tags
    removed, no length limits), the page language, and a truncated preview."""
    p = roles.table(spark, d, "pages").select("page_id", "html", T.longest_block("html").alias("best"))
    return p.select("page_id", F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"),
                    F.length("best").alias("main_chars"), T.truncate("best", 80).alias("main_preview"))


# ---------------------------------------------------------------- V4/V5/V6 pooling

@register("vector_pool", """
WITH u AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i),
nrm AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label),
z AS (SELECT m.label, m.i, CASE WHEN nrm.norm = 0 THEN m.m ELSE m.m / nrm.norm END AS z FROM m JOIN nrm USING (label))
SELECT z.label, CAST(count(*) AS INTEGER) AS dims, round(max(nrm.norm), 6) AS mean_norm,
       CAST(count(*) FILTER (WHERE abs(z.z) >= 0.01) AS INTEGER) AS nnz, round(sum(CASE WHEN abs(z.z) < 0.01 THEN 0 ELSE z.z END), 6) AS sum_sparse
FROM z JOIN nrm USING (label) GROUP BY z.label
""")
def q_vector_pool(spark, d):
    """V4 → V5 → V6: mean vector per label, L2-normalised, sparsified at 0.01."""
    e = roles.table(spark, d, "embeddings")
    pooled = mean_pool(e, "label", "embedding", "mean")
    from ..functions.vectors import norm
    z = pooled.select("label", norm(F.col("mean")).alias("mean_norm"), sparsify(l2_normalize(F.col("mean")), 0.01).alias("z"))
    return z.select("label", F.size("z").alias("dims"), r6("mean_norm").alias("mean_norm"),
                    F.size(F.filter("z", lambda x: x != 0)).alias("nnz"),
                    r6(F.aggregate("z", F.lit(0.0), lambda a, x: a + x)).alias("sum_sparse"))


# ---------------------------------------------------------------- M25

@register("roc_auc", f"""
WITH s AS ({R.DECISIONS}),
r AS (SELECT target, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS c FROM s),
t AS (SELECT sum(CASE WHEN target = 1 THEN rk + (c - 1) / 2.0 END) AS rs, count(*) FILTER (WHERE target = 1) AS p,
             count(*) FILTER (WHERE target = 0) AS n FROM r)
SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auc, p AS n_pos, n AS n_neg FROM t
""")
def q_roc_auc(spark, d):
    """Area under ROC of the decision scores (Spark ML evaluator, exact:
    no threshold down-sampling)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = roles.decisions(spark, d).select(F.col("score").cast("double").alias("score"),
                                         F.col("target").cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0)
    auc = ev.evaluate(s)
    counts = s.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    return counts.select(F.round(F.lit(auc), 6).alias("auc"), "n_pos", "n_neg")


# ---------------------------------------------------------------- F22, F46

from ..functions import parse as PZ  # noqa: E402

_EXCL_PATHS_SQL = ", ".join(f"'{p}'" for p in PZ.EXCLUDED_PATHS)
_EXCL_PREF_SQL = " OR ".join(f"starts_with(href, '{p}')" for p in PZ.EXCLUDED_PREFIXES)


@register("profile_links", f"""
SELECT href, min(page_id) AS first_page, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
WHERE regexp_full_match(href, '/[a-zA-Z][a-zA-Z0-9_-]{{2,}}') AND href NOT IN ({_EXCL_PATHS_SQL})
  AND NOT ({_EXCL_PREF_SQL})
GROUP BY href
""")
def q_profile_links(spark, d):
    """Distinct profile links found on list pages."""
    from ..sources import pages
    links = pages.page_links(roles.table(spark, d, "pages"))
    return links.filter(PZ.is_profile_link("href"))


@register("area_lookup", f"""
WITH r AS ({R.RESUMES})
SELECT r.resume_id, r.resume_location, n.n_nationkey AS area_id, g.r_name AS region
FROM r LEFT JOIN nation n ON n.n_name = r.resume_location LEFT JOIN region g ON g.r_regionkey = n.n_regionkey
""")
def q_area_lookup(spark, d):
    """location name → area id and region through the dimension tables
    (unknown names keep null ids)."""
    res = roles.resumes(spark, d).select("resume_id", "resume_location")
    nat = roles.table(spark, d, "nation")
    reg = roles.table(spark, d, "region")
    x = PZ.dimension_lookup(res, "resume_location", nat, "n_name", "n_nationkey", "area_id")
    x = x.join(nat.select(F.col("n_nationkey").alias("area_id"), "n_regionkey"), "area_id", "left")
    x = x.join(reg.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")),
               "n_regionkey", "left")
    return x.select("resume_id", "resume_location", "area_id", "region")


@register("schedule_mapping", f"""
WITH v AS ({R.VACANCIES}),
t AS (SELECT vacancy_id, vacancy_schedule_raw AS r, lower(regexp_replace(vacancy_schedule_raw, '\\s+', ' ', 'g')) AS t FROM v)
SELECT vacancy_id, r AS vacancy_schedule_raw,
  CASE WHEN r IS NULL OR r = '' THEN ''
       WHEN contains(t, 'сменн') THEN 'Сменный график'
       WHEN contains(t, 'гибрид') OR (contains(t, 'удал') AND (contains(t, 'или') OR contains(t, ', '))) THEN 'Гибкий график'
       WHEN contains(t, 'удал') THEN 'Удаленная работа'
       WHEN contains(t, 'на месте') OR contains(t, 'офис') THEN 'Полный день'
       ELSE r END AS schedule_a,
  CASE WHEN r IS NULL OR r = '' THEN ''
       WHEN contains(t, 'сменн') OR contains(t, '2/2') OR contains(t, '3/3') THEN 'Сменный график'
       WHEN contains(t, 'гибк') OR contains(t, 'свободн') THEN 'Гибкий график'
       WHEN contains(t, 'удал') OR contains(t, 'дистанц') OR contains(t, 'remote') THEN 'Удаленная работа'
       WHEN contains(t, 'стандартн') OR contains(t, 'полн') OR contains(t, '5/2') THEN 'Полный день'
       WHEN contains(t, 'вахт') THEN 'Вахтовый метод'
       ELSE trim(r) END AS schedule_b
FROM t
""")
def q_schedule_mapping(spark, d):
    """The two crawlers' schedule mappings."""
    v = roles.vacancies(spark, d)
    return v.select("vacancy_id", "vacancy_schedule_raw", T.schedule_variant_a("vacancy_schedule_raw").alias("schedule_a"),
                    T.schedule_variant_b("vacancy_schedule_raw").alias("schedule_b"))


@register("corpus_stack", f"""
WITH v AS ({R.VACANCIES}), r AS ({R.RESUMES}),
s AS (SELECT DISTINCT vacancy_description AS text, 'vacancy_description' AS origin FROM v
      UNION ALL SELECT DISTINCT resume_last_position, 'resume_last_position' FROM r)
SELECT origin, count(*) AS n_texts, count(DISTINCT text) AS n_distinct FROM s GROUP BY origin
""")
def q_corpus_stack(spark, d):
    """Stacked distinct corpora of the two entity texts (for fitting)."""
    from ..operators.sets import corpus_stack
    s = corpus_stack(roles.vacancies(spark, d), "vacancy_description", roles.resumes(spark, d), "resume_last_position")
    return s.groupBy("origin").agg(F.count(F.lit(1)).alias("n_texts"), F.countDistinct("text").alias("n_distinct"))


# ---------------------------------------------------------------- A7, W8, O3/O4, O5

@register("target_rate_filtered", """
SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_pos, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_neg,
       round(CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0
                  THEN count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*) END, 6) AS pos_pct,
       round(CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'F') > 0
                  THEN count(*) FILTER (WHERE o_orderstatus <> 'F') * 100.0 / count(*) END, 6) AS neg_pct
FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderpriority
""")
def q_target_rate_filtered(spark, d):
    """The category rate table on a filtered subset (large orders)."""
    o = (roles.table(spark, d, "orders").filter(F.col("o_totalprice") > 200000)
         .withColumn("target", (F.col("o_orderstatus") == "F").cast("int")))
    g = A.rate_by_category(o, "target", ["o_orderpriority"])
    return g.select("column", "value", "n", "n_pos", "n_neg", r6("pos_pct").alias("pos_pct"),
                    r6("neg_pct").alias("neg_pct"))


@register("nested_split", f"""
WITH s AS ({R.DECISIONS}),
p AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY {R.hash_key('42', 'doc_id')}, doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY target) AS n FROM s),
tr AS (SELECT doc_id, target FROM p WHERE pos >= ceil(n * 0.2)),
q AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY {R.hash_key('7', 'doc_id')}, doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY target) AS n FROM tr)
SELECT doc_id, target, CASE WHEN pos < ceil(n * 0.3) THEN 'holdout' ELSE 'fit' END AS part FROM q
""")
def q_nested_split(spark, d):
    """70 % of the training part (itself 80 % of the data) for fitting
    the ALS feature, stratified, with a second seed."""
    s = roles.decisions(spark, d).select("doc_id", "target")
    train = RK.stratified_split(s, "target", "doc_id", 0.2, "42").filter(F.col("split") == "train").drop("split")
    inner = RK.stratified_split(train, "target", "doc_id", 0.3, "7", out="part")
    return inner.select("doc_id", "target", F.when(F.col("part") == "test", "holdout").otherwise("fit").alias("part"))


@register("seeded_sample", f"""
SELECT doc_id, source FROM documents ORDER BY {R.hash_key('200', 'doc_id')}, doc_id LIMIT 200
""")
def q_seeded_sample(spark, d):
    """A seeded simple random sample of 200 rows (the sample is the
    feature: robustness checks run on it)."""
    docs = roles.table(spark, d, "documents").select("doc_id", "source")
    return RK.sample_n(docs, 200, "200", ["doc_id"])


@register("random_group", f"""
WITH g AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY {R.hash_key('g', 'source')}, source LIMIT 1)
SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN g ON d.source = g.source
""")
def q_random_group(spark, d):
    """Pick one group at random (seeded) and return its rows."""
    docs = roles.table(spark, d, "documents")
    g = RK.sample_n(docs.select("source").distinct(), 1, "g", ["source"])
    return docs.join(g, "source", "left_semi").select("doc_id", "source", "n_chars")

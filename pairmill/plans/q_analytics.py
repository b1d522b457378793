"""Registered queries: EDA aggregates, service statistics, paging, JSON docs,
splits and per-group ranking metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agg as A
from ..operators import rank as RK
from ..operators.agg import join_one_row
from ..operators.metrics import error_table, group_ndcg, group_prf, top_errors
from ..operators.quantiles import profile
from ..sources import roles
from ..sources.io import to_json_docs
from . import oracle_roles as R
from .catalog import register

r6 = lambda c: F.round(c, 6)


@register("missing_profile", f"""
WITH n AS ({R.NUMERIC_PROFILE}), t AS (SELECT count(*) AS c FROM n)
SELECT col AS "column", CAST(nn AS BIGINT) AS n_null, round(nn / c, 6) AS share FROM (
  SELECT 'resume_age' AS col, count(*) FILTER (WHERE resume_age IS NULL) AS nn FROM n
  UNION ALL SELECT 'resume_experience_months', count(*) FILTER (WHERE resume_experience_months IS NULL) FROM n
  UNION ALL SELECT 'resume_last_company_experience_months',
                   count(*) FILTER (WHERE resume_last_company_experience_months IS NULL) FROM n
  UNION ALL SELECT 'resume_salary', count(*) FILTER (WHERE resume_salary IS NULL) FROM n
  UNION ALL SELECT 'segment', count(*) FILTER (WHERE segment IS NULL) FROM n), t
""")
def q_missing_profile(spark, d):
    """A3: null count and share per column."""
    n = roles.numeric_profile(spark, d)
    p = A.missing_profile(n, ["resume_age", "resume_experience_months", "resume_last_company_experience_months",
                              "resume_salary", "segment"])
    return p.select("column", "n_null", r6("share").alias("share"))


@register("sparsity", f"""
WITH n AS ({R.NUMERIC_PROFILE})
SELECT CAST(sum((resume_age IS NULL)::INT + (resume_experience_months IS NULL)::INT
          + (resume_last_company_experience_months IS NULL)::INT + (resume_salary IS NULL)::INT
          + (segment IS NULL)::INT + (resume_id IS NULL)::INT) AS BIGINT) AS null_cells,
       count(*) * 6 AS cells,
       round(sum((resume_age IS NULL)::INT + (resume_experience_months IS NULL)::INT
          + (resume_last_company_experience_months IS NULL)::INT + (resume_salary IS NULL)::INT
          + (segment IS NULL)::INT + (resume_id IS NULL)::INT) / (count(*) * 6.0), 6) AS sparsity
FROM n
""")
def q_sparsity(spark, d):
    """A4: dataset sparsity."""
    s = A.sparsity(roles.numeric_profile(spark, d))
    return s.select("null_cells", "cells", r6("sparsity").alias("sparsity"))


@register("value_shares", """
WITH u AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem
           UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", value, n, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS share FROM c
""")
def q_value_shares(spark, d):
    """A2: value counts, absolute and normalised."""
    li = roles.table(spark, d, "lineitem")
    return A.value_shares(li, ["l_returnflag", "l_linestatus"]).withColumn("share", r6("share"))


@register("duplicates", """
SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) AS n_distinct
FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
""")
def q_duplicates(spark, d):
    """A5: duplicate rows by key."""
    li = roles.table(spark, d, "lineitem")
    return A.duplicate_count(li, ["l_partkey", "l_suppkey"])


TARGET_RATE_SQL = """
WITH u AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value,
                  CAST(o_orderstatus = 'F' AS INTEGER) AS target FROM orders
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, CAST(o_orderstatus = 'F' AS INTEGER) FROM orders)
SELECT "column", value, count(*) AS n, count(*) FILTER (WHERE target = 1) AS n_pos,
       count(*) FILTER (WHERE target = 0) AS n_neg,
       round(CASE WHEN count(*) FILTER (WHERE target = 1) > 0
                  THEN count(*) FILTER (WHERE target = 1) * 100.0 / count(*) END, 6) AS pos_pct,
       round(CASE WHEN count(*) FILTER (WHERE target = 0) > 0
                  THEN count(*) FILTER (WHERE target = 0) * 100.0 / count(*) END, 6) AS neg_pct
FROM u GROUP BY "column", value
"""


@register("target_rate_by_category", TARGET_RATE_SQL)
def q_target_rate(spark, d):
    """positive/negative percentage per category value (null when absent)."""
    o = roles.table(spark, d, "orders").withColumn("target", (F.col("o_orderstatus") == "F").cast("int"))
    g = A.rate_by_category(o, "target", ["o_orderpriority", "o_orderstatus"])
    return g.select("column", "value", "n", "n_pos", "n_neg", r6("pos_pct").alias("pos_pct"),
                    r6("neg_pct").alias("neg_pct"))


def _salary_sql():
    from .q_core import SALARY_SQL
    return SALARY_SQL


@register("salary_bins", f"""
WITH s AS ({_salary_sql()}),
tg AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS resume_id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT s.resume_id, CAST(least(greatest(ceil(salary_rub / 50000.0), 1), 21) AS INTEGER) AS bin,
             CASE WHEN tg.resume_id IS NULL THEN 0 ELSE 1 END AS target
      FROM s LEFT JOIN tg ON s.resume_id = tg.resume_id)
SELECT bin, CAST((bin - 1) * 50000.0 AS DOUBLE) AS lo, CAST(CASE WHEN bin <= 20 THEN bin * 50000.0 END AS DOUBLE) AS hi,
       count(*) AS n, round(avg(target), 6) AS rate
FROM b GROUP BY bin
""")
def q_salary_bins(spark, d):
    """Right-closed 50 000-wide salary bins with the rate of customers
    that have a fulfilled order."""
    r = roles.resumes(spark, d).select("resume_id", T.salary_to_rub("resume_salary_text").alias("salary"))
    tg = (roles.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
          .select(F.col("o_custkey").cast("string").alias("resume_id")).distinct().withColumn("target", F.lit(1)))
    x = r.join(tg, "resume_id", "left").withColumn("target", F.coalesce("target", F.lit(0)))
    return A.binned_rate(x, "salary", "target").withColumn("rate", r6("rate"))


@register("histogram20", """
WITH u AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS v FROM lineitem
           UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
           UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
mm AS (SELECT "column", min(v) AS mn, max(v) AS mx FROM u WHERE v IS NOT NULL GROUP BY 1),
c AS (SELECT u."column", CAST(CASE WHEN mx - mn = 0 THEN 0 ELSE least(floor((v - mn) * 20 / (mx - mn)), 19) END AS INTEGER) AS bin,
             count(*) AS n FROM u JOIN mm ON u."column" = mm."column" WHERE v IS NOT NULL GROUP BY 1, 2),
g AS (SELECT "column", mn, mx, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM mm)
SELECT g."column", g.bin, round(mn + g.bin * ((mx - mn) / 20), 6) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 20), 6) AS hi,
       coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON g."column" = c."column" AND g.bin = c.bin
""")
def q_histogram20(spark, d):
    """A10: 20-bin equal-width histograms of lineitem numerics."""
    li = roles.table(spark, d, "lineitem")
    h = A.histogram(li, ["l_quantity", "l_extendedprice", "l_discount"], 20)
    return h.select("column", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@register("pearson_pairs", """
WITH x AS (
  SELECT 'ALL' AS segment, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_tax) AS b,
         corr(l_quantity, l_discount) AS c FROM lineitem
  UNION ALL
  SELECT l_returnflag, corr(l_quantity, l_extendedprice), corr(l_discount, l_tax), corr(l_quantity, l_discount)
  FROM lineitem GROUP BY l_returnflag)
SELECT segment, 'l_quantity' AS x, 'l_extendedprice' AS y, round(a, 6) AS r FROM x
UNION ALL SELECT segment, 'l_discount', 'l_tax', round(b, 6) FROM x
UNION ALL SELECT segment, 'l_quantity', 'l_discount', round(c, 6) FROM x
""")
def q_pearson_pairs(spark, d):
    """Pearson correlations, overall and per return flag."""
    li = roles.table(spark, d, "lineitem")
    t = A.corr_table(li, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "l_discount")],
                     by="l_returnflag")
    return t.withColumn("r", r6("r"))


def _cramer_sql(tbl, a, b):
    return f"""
SELECT '{a}' AS x, '{b}' AS y, CAST(n AS BIGINT) AS n, round(n * (q - 1), 6) AS chi2,
       round(CASE WHEN least(r, c) - 1 > 0 THEN sqrt(n * (q - 1) / (n * (least(r, c) - 1))) END, 6) AS cramers_v
FROM (
  SELECT sum(o * o / (ra * cb)) AS q, sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM (
    SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM (
      SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {tbl}
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)))"""


@register("cramers_v", _cramer_sql("lineitem", "l_returnflag", "l_linestatus") + " UNION ALL "
          + _cramer_sql("orders", "o_orderpriority", "o_orderstatus"))
def q_cramers_v(spark, d):
    """Chi-square and Cramér's V for two categorical pairs."""
    li = roles.table(spark, d, "lineitem")
    o = roles.table(spark, d, "orders")
    out = A.cramers_v(li, "l_returnflag", "l_linestatus").unionByName(A.cramers_v(o, "o_orderpriority", "o_orderstatus"))
    return out.select("x", "y", "n", r6("chi2").alias("chi2"), r6("cramers_v").alias("cramers_v"))


SERVICE_STATS_SQL = f"""
WITH s AS ({R.SERVICE_LOG})
SELECT count(*) AS total_requests, round(avg(processing_time), 6) AS mean,
       round(quantile_cont(processing_time, 0.5), 6) AS p50, round(quantile_cont(processing_time, 0.95), 6) AS p95,
       round(quantile_cont(processing_time, 0.99), 6) AS p99,
       round(min(processing_time), 6) AS min, round(max(processing_time), 6) AS max,
       round(avg(k), 6) AS k_mean, round(quantile_cont(k, 0.5), 6) AS k_median,
       count(*) FILTER (WHERE prediction = 1) AS positive_predictions,
       count(*) FILTER (WHERE prediction = 0) AS negative_predictions
FROM s
"""


@register("service_stats", SERVICE_STATS_SQL)
def q_service_stats(spark, d):
    """Request count, latency mean/p50/p95/p99/min/max, input mean and
    median, prediction counts — exact quantiles from a distributed sort."""
    s = roles.service_log(spark, d)
    base = s.agg(F.count(F.lit(1)).alias("total_requests"), r6(F.avg("processing_time")).alias("mean"),
                 r6(F.min("processing_time")).alias("min"), r6(F.max("processing_time")).alias("max"),
                 r6(F.avg("k")).alias("k_mean"),
                 F.count_if(F.col("prediction") == 1).alias("positive_predictions"),
                 F.count_if(F.col("prediction") == 0).alias("negative_predictions"))
    q = A.exact_quantiles(s, "processing_time", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    km = A.exact_quantiles(s, "k", {"k_median": 0.5})
    j = join_one_row(join_one_row(base, q), km)
    return j.select("total_requests", "mean", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"),
                    "min", "max", "k_mean", r6("k_median").alias("k_median"), "positive_predictions",
                    "negative_predictions")


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
TAILS = QUARTILES | {"p95": 0.95, "p99": 0.99}


def _profile_sql(source, cols, probs):
    return f"WITH s AS ({source}) " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 6) AS std,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max,
       {", ".join(f'round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS {n}' for n, p in probs.items())}
FROM s""" for c in cols)


def _profile(df, cols, probs):
    out = profile(df, cols, probs)
    return out.select("column", "count", F.round("mean", 4).alias("mean"), *[r6(c).alias(c) for c in out.columns[3:]])


INPUTS = ["processing_time", "resume_age", "resume_salary", "resume_experience_months", "resume_last_company_experience_months", "k"]


@register("service_inputs", _profile_sql(
    f"SELECT * FROM ({R.SERVICE_LOG}) LEFT JOIN ({R.NUMERIC_PROFILE}) USING (resume_id)", INPUTS, TAILS))
def q_service_inputs(spark, d):
    """Latency and all five inputs of the logged requests (means, medians,
    tails), every column in the same few passes (``operators.quantiles``)."""
    log = roles.service_log(spark, d).join(roles.numeric_profile(spark, d), "resume_id", "left")
    return _profile(log, INPUTS, TAILS)


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("describe_quartiles", _profile_sql("SELECT * FROM lineitem", DESCRIBED, QUARTILES))
def q_describe_quartiles(spark, d):
    """Count, mean, std, min, quartiles and max of all numeric columns of a table at once."""
    return _profile(roles.table(spark, d, "lineitem"), DESCRIBED, QUARTILES)


BATCH_SUMMARY_SQL = f"""
WITH s AS ({R.DECISIONS})
SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.5) AS recommended,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE score >= 0.5) / count(*) ELSE 0 END, 6) AS recommended_rate,
       round(avg(score), 6) AS mean_probability, round(quantile_cont(score, 0.5), 6) AS median_probability,
       (SELECT doc_id FROM s ORDER BY score DESC, doc_id DESC LIMIT 1) AS top_id,
       round(max(score), 6) AS top_probability, round(avg(n_chars), 6) AS mean_n_chars
FROM s
"""


@register("batch_summary", BATCH_SUMMARY_SQL)
def q_batch_summary(spark, d):
    """Batch totals, recommended rate, mean/median probability, top row."""
    s = roles.decisions(spark, d)
    base = s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= 0.5).alias("recommended"),
                 r6(F.avg("score")).alias("mean_probability"),
                 F.max(F.struct("score", "doc_id")).alias("__top"), r6(F.avg("n_chars")).alias("mean_n_chars"))
    med = A.exact_quantiles(s, "score", {"median_probability": 0.5})
    j = join_one_row(base, med)
    rate = F.when(F.col("total") > 0, F.col("recommended") / F.col("total")).otherwise(F.lit(0.0))
    return j.select("total", "recommended", r6(rate).alias("recommended_rate"), "mean_probability",
                    r6("median_probability").alias("median_probability"), F.col("__top.doc_id").alias("top_id"),
                    r6(F.col("__top.score")).alias("top_probability"), "mean_n_chars")


@register("confusion", f"""
WITH s AS ({R.DECISIONS}),
c AS (SELECT target, count(*) FILTER (WHERE score < 0.5) AS n_pred0, count(*) FILTER (WHERE score >= 0.5) AS n_pred1
      FROM s GROUP BY target)
SELECT target, n_pred0, n_pred1, round(n_pred0 / (n_pred0 + n_pred1), 6) AS share_pred0,
       round(n_pred1 / (n_pred0 + n_pred1), 6) AS share_pred1 FROM c
""")
def q_confusion(spark, d):
    """Confusion matrix at 0.5, raw and row-normalised."""
    s = roles.decisions(spark, d).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    c = s.groupBy("target").pivot("pred", [0, 1]).count().na.fill(0)
    c = c.select("target", F.col("0").alias("n_pred0"), F.col("1").alias("n_pred1"))
    tot = F.col("n_pred0") + F.col("n_pred1")
    return c.select("target", "n_pred0", "n_pred1", r6(F.col("n_pred0") / tot).alias("share_pred0"),
                    r6(F.col("n_pred1") / tot).alias("share_pred1"))


@register("recent_gate", """
WITH m AS (SELECT max(ts) AS as_of FROM events)
SELECT m.as_of, count(e.ts) AS n_recent, count(e.ts) > 0 AS has_new
FROM m LEFT JOIN events e ON e.ts >= m.as_of - INTERVAL 1 DAY GROUP BY m.as_of
""")
def q_recent_gate(spark, d):
    """Activity in the 24 h before ``as_of`` (as_of = newest event)."""
    s = roles.service_log(spark, d)
    from ..session import scalar
    as_of = scalar(s.agg(F.max("created_at")))
    n = s.filter(F.col("created_at") >= F.lit(as_of) - F.expr("INTERVAL 1 DAY")).agg(
        F.count(F.lit(1)).alias("n_recent"))
    return n.select(F.lit(as_of).cast("timestamp").alias("as_of"), "n_recent",
                    (F.col("n_recent") > 0).alias("has_new"))


@register("history_page", f"""
WITH s AS ({R.SERVICE_LOG})
SELECT id, created_at, resume_id, round(processing_time, 6) AS processing_time
FROM s ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20
""")
def q_history_page(spark, d):
    """O1: history page 2 (skip 20, take 50), newest first."""
    s = roles.service_log(spark, d)
    p = RK.page(s, [F.desc("created_at"), F.desc("id")], 20, 50)
    return p.select("id", "created_at", "resume_id", r6("processing_time").alias("processing_time"))


@register("json_features", """
SELECT o_orderkey, CAST(to_json({'o_orderstatus': coalesce(o_orderstatus, 'NDT'),
                            'o_orderpriority': coalesce(o_orderpriority, 'NDT'),
                            'o_custkey': coalesce(o_custkey, 0),
                            'o_totalprice': coalesce(o_totalprice, 0.0)}) AS VARCHAR) AS features_json
FROM orders
""")
def q_json_features(spark, d):
    """Every row as a JSON feature document with defaults."""
    o = roles.table(spark, d, "orders")
    return to_json_docs(o, "o_orderkey", {"o_orderstatus": "NDT", "o_orderpriority": "NDT", "o_custkey": 0,
                                          "o_totalprice": 0.0})


# ---------------------------------------------------------------- splits and samples

@register("stratified_split", f"""
WITH s AS ({R.DECISIONS}),
p AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY {R.hash_key('42', 'doc_id')}, doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY target) AS n FROM s)
SELECT doc_id, target, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM p
""")
def q_stratified_split(spark, d):
    """Exact stratified 80/20 split (seeded)."""
    s = roles.decisions(spark, d).select("doc_id", "target")
    return RK.stratified_split(s, "target", "doc_id", 0.2, "42")


@register("stratified_folds", f"""
WITH s AS ({R.DECISIONS})
SELECT doc_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY {R.hash_key('7', 'doc_id')}, doc_id) - 1) % 3 AS INTEGER) AS fold
FROM s
""")
def q_stratified_folds(spark, d):
    """Stratified 3-fold assignment (seeded)."""
    s = roles.decisions(spark, d).select("doc_id", "target")
    return RK.stratified_folds(s, "target", "doc_id", 3, "7")


@register("balanced_sample", f"""
WITH s AS ({R.DECISIONS})
SELECT doc_id, target FROM (
  SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY {R.hash_key('42', 'doc_id')}, doc_id) AS r FROM s)
WHERE r <= 150
""")
def q_balanced_sample(spark, d):
    """At most 150 rows per class, seeded."""
    s = roles.decisions(spark, d).select("doc_id", "target")
    return RK.balanced_sample(s, "target", "doc_id", 150, "42")


# ---------------------------------------------------------------- ranking metrics

NDCG_CTE = f"""
WITH s AS ({R.DECISIONS}),
p AS (SELECT group_id, doc_id, score, target,
             row_number() OVER (PARTITION BY group_id ORDER BY score DESC, doc_id) - 1 AS pos,
             count(*) OVER (PARTITION BY group_id) AS n, sum(target) OVER (PARTITION BY group_id) AS npos FROM s),
d AS (SELECT *, 1.0 / log2(pos + 2) AS disc FROM p),
t AS (SELECT group_id, score, avg(disc) AS ad, sum(target) AS st FROM d GROUP BY group_id, score),
dcg AS (SELECT group_id, sum(ad * st) AS dcg FROM t GROUP BY group_id),
idcg AS (SELECT group_id, sum(CASE WHEN pos < npos THEN disc ELSE 0 END) AS idcg, max(n) AS n FROM d GROUP BY group_id)
SELECT group_id, n, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg
FROM dcg JOIN idcg USING (group_id) WHERE n > 1
"""
NDCG_SQL = f"SELECT group_id, n, round(ndcg, 6) AS ndcg FROM ({NDCG_CTE})"


@register("group_ndcg", NDCG_SQL)
def q_group_ndcg(spark, d):
    """Tie-averaged NDCG per group (groups with ≤ 1 row skipped)."""
    s = roles.decisions(spark, d)
    return group_ndcg(s, "group_id", "score", "target", "doc_id").withColumn("ndcg", r6("ndcg"))


PRF_CTE = f"""
WITH s AS ({R.DECISIONS}),
g AS (SELECT group_id, count(*) AS n,
             count(*) FILTER (WHERE score >= 0.5 AND target = 1) AS tp,
             count(*) FILTER (WHERE score >= 0.5 AND target = 0) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND target = 1) AS fn FROM s GROUP BY group_id),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM g)
SELECT group_id, n, tp, fp, fn, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
FROM m WHERE n > 1
"""
PRF_SQL = f"""
SELECT group_id, n, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({PRF_CTE})
"""


@register("group_prf", PRF_SQL)
def q_group_prf(spark, d):
    """Precision / recall / F1 per group at 0.5 (zero division → 0)."""
    s = roles.decisions(spark, d)
    g = group_prf(s, "group_id", "score", "target", 0.5)
    return g.select("group_id", "n", "tp", "fp", "fn", r6("precision").alias("precision"),
                    r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("group_metrics_mean", f"""
WITH a AS ({NDCG_CTE}), b AS ({PRF_CTE})
SELECT count(*) AS n_groups, round(avg(ndcg), 6) AS ndcg, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1
FROM a JOIN b USING (group_id)
""")
def q_group_metrics_mean(spark, d):
    """Macro averages over groups (the reference's headline)."""
    s = roles.decisions(spark, d)
    nd = group_ndcg(s, "group_id", "score", "target", "doc_id")
    pr = group_prf(s, "group_id", "score", "target", 0.5).select("group_id", "precision", "recall", "f1")
    j = nd.join(pr, "group_id")  # averages of unrounded values, rounded once
    return j.agg(F.count(F.lit(1)).alias("n_groups"), r6(F.avg("ndcg")).alias("ndcg"),
                 r6(F.avg("precision")).alias("precision"), r6(F.avg("recall")).alias("recall"),
                 r6(F.avg("f1")).alias("f1"))


@register("top_errors", f"""
WITH s AS ({R.DECISIONS}),
fp AS (SELECT 'FP' AS error_type, doc_id, score, target,
              CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score >= 0.5 AND target = 0),
fn AS (SELECT 'FN' AS error_type, doc_id, score, target,
              CAST(row_number() OVER (ORDER BY score ASC, doc_id) AS INTEGER) AS rank FROM s WHERE score < 0.5 AND target = 1)
SELECT * FROM fp WHERE rank <= 10 UNION ALL SELECT * FROM fn WHERE rank <= 10
""")
def q_top_errors(spark, d):
    """The 10 most confident false positives and false negatives."""
    s = roles.decisions(spark, d)
    return top_errors(s, "doc_id", "score", "target", 10, 0.5).select("error_type", "doc_id", "score", "target", "rank")


@register("error_summary", f"""
WITH s AS ({R.DECISIONS}),
e AS (SELECT *, CASE WHEN score >= 0.5 AND target = 1 THEN 'TP' WHEN score >= 0.5 THEN 'FP'
                     WHEN target = 1 THEN 'FN' ELSE 'TN' END AS error_type FROM s)
SELECT error_type, count(*) AS n, round(avg(score), 3) AS mean_score, round(avg(n_chars), 3) AS mean_n_chars,
       round(avg(toxic), 3) AS mean_toxic
FROM e GROUP BY error_type
""")
def q_error_summary(spark, d):
    """Per error class means, rounded to 3."""
    e = error_table(roles.decisions(spark, d), "score", "target", 0.5)
    return e.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("mean_score"),
                                       F.round(F.avg("n_chars"), 3).alias("mean_n_chars"),
                                       F.round(F.avg("toxic"), 3).alias("mean_toxic"))


@register("class_weights", f"""
WITH s AS ({R.DECISIONS}), g AS (SELECT target, count(*) AS n_class FROM s GROUP BY target)
SELECT target, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS weight,
       round(sum(CASE WHEN target = 0 THEN n_class END) OVER () / sum(CASE WHEN target = 1 THEN n_class END) OVER (), 6)
         AS scale_pos_weight
FROM g
""")
def q_class_weights(spark, d):
    """Balanced class weights and n_neg/n_pos."""
    w = A.class_weights(roles.decisions(spark, d), "target")
    return w.select("target", "n_class", r6("weight").alias("weight"), r6("scale_pos_weight").alias("scale_pos_weight"))

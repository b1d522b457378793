"""Registered queries: matching, snapshots, joins, scalar features, cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import default_stop_words
from ..operators import clean as C
from ..operators.joins import anti_join, negative_pairs, semi_join
from ..operators.rank import latest_per_key
from ..session import ensure_checkpoint_dir
from ..sources import roles
from ..sources.io import upsert
from ..sources.keyed import read_keyed, upsert_keyed
from . import oracle_roles as R
from .catalog import register
from .matching import top_candidates

# ---------------------------------------------------------------- matching

TOP_CANDIDATES_SQL = f"""
WITH v AS ({R.VACANCIES}), r AS ({R.RESUMES}),
p AS (SELECT v.vacancy_id, r.resume_id, r.resume_location, r.resume_last_position, {R.PAIR_FEATURES}
      FROM v, r),
s AS (SELECT *, round(location_matching + resume_skill_count_in_vacancy + last_position_in_vacancy, 9) AS s9
      FROM p),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vacancy_id ORDER BY s9 DESC, resume_id) AS INTEGER) AS rank
      FROM s)
SELECT vacancy_id, rank, resume_id,
       round(location_matching + resume_skill_count_in_vacancy + last_position_in_vacancy, 6) AS score,
       location_matching, CAST(resume_skill_count_in_vacancy AS INTEGER) AS resume_skill_count_in_vacancy,
       round(last_position_in_vacancy, 6) AS last_position_in_vacancy,
       resume_location, resume_last_position
FROM k WHERE rank <= 10
"""


@register("top_candidates", TOP_CANDIDATES_SQL)
def q_top_candidates(spark, d):
    """Top-10 résumés per vacancy by the hand-feature score."""
    return top_candidates(roles.vacancies(spark, d), roles.resumes(spark, d), k=10)


# ---------------------------------------------------------------- snapshots



def _snap_cols(df):
    return df.select("id", "source", "parsed_date", "event_id", F.round("value", 6).alias("value"))


@register("latest_snapshot", f"""
WITH s AS ({R.SNAPSHOTS})
SELECT id, source, parsed_date, event_id, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY parsed_date DESC, event_id DESC) AS rn FROM s) WHERE rn = 1
""")
def q_latest_snapshot(spark, d):
    """W1 (ties='one'): newest snapshot per id, ties broken by event_id."""
    s = roles.snapshots(spark, d).drop("ts")
    return _snap_cols(latest_per_key(s, ["id"], "parsed_date", ties="one", tiebreak=["event_id"]))


@register("latest_snapshot_strict", f"""
WITH s AS ({R.SNAPSHOTS}),
m AS (SELECT id, max(parsed_date) AS md FROM s GROUP BY id),
c AS (SELECT s.id, count(*) AS n FROM s JOIN m ON s.id = m.id AND s.parsed_date = m.md GROUP BY s.id)
SELECT s.id, s.source, s.parsed_date, s.event_id, round(s.value, 6) AS value
FROM s JOIN m ON s.id = m.id AND s.parsed_date = m.md JOIN c ON c.id = s.id WHERE c.n = 1
""")
def q_latest_snapshot_strict(spark, d):
    """W1 (ties='drop'): the reference's rule, tied newest rows vanish."""
    s = roles.snapshots(spark, d).drop("ts")
    return _snap_cols(latest_per_key(s, ["id"], "parsed_date", ties="drop", tiebreak=["event_id"]))


UPSERT_SQL = f"""
WITH s AS ({R.SNAPSHOTS}),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY parsed_date DESC, event_id DESC) rn
                     FROM s WHERE day(ts) <= 20) WHERE rn = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY parsed_date DESC, event_id DESC) rn
                     FROM s WHERE day(ts) > 10) WHERE rn = 1)
SELECT id, source, parsed_date, event_id, round(value, 6) AS value, 'old' AS origin
FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = o.id AND n.source = o.source)
UNION ALL
SELECT id, source, parsed_date, event_id, round(value, 6) AS value, 'new' AS origin FROM n
"""


@register("upsert_snapshot", UPSERT_SQL)
def q_upsert_snapshot(spark, d):
    """Upsert by (id, source) of a newer crawl batch over an older one
    (batches = events up to day 20 / from day 11, each reduced to the newest
    row per key)."""
    s = roles.snapshots(spark, d)
    old = latest_per_key(s.filter(F.dayofmonth("ts") <= 20).drop("ts"), ["id", "source"], "parsed_date",
                         tiebreak=["event_id"]).withColumn("origin", F.lit("old"))
    new = latest_per_key(s.filter(F.dayofmonth("ts") > 10).drop("ts"), ["id", "source"], "parsed_date",
                         tiebreak=["event_id"]).withColumn("origin", F.lit("new"))
    out = upsert(old, new, ["id", "source"])
    return out.select("id", "source", "parsed_date", "event_id", F.round("value", 6).alias("value"), "origin")


@register("keyed_upsert", f"""
SELECT id, source, parsed_date, event_id, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY parsed_date DESC, event_id DESC) rn FROM ({R.SNAPSHOTS}))
WHERE rn = 1
""")
def q_keyed_upsert(spark, d):
    """S10/X18/ST1: two crawl batches (a new one, then the backlog before it)
    upserted one after the other into a bucketed table in the shared folder;
    a late batch does not replace newer rows."""
    s = roles.snapshots(spark, d)
    keys, path = ["id", "source"], f"{ensure_checkpoint_dir(spark).rstrip('/')}/keyed-{uuid.uuid4().hex}"
    for part in (s.filter(F.dayofmonth("ts") > 10), s.filter(F.coalesce(F.dayofmonth("ts") <= 10, F.lit(True)))):
        new = latest_per_key(part.drop("ts"), keys, "parsed_date", tiebreak=["event_id"])
        upsert_keyed(new, path, keys, "parsed_date", buckets=8)
    return _snap_cols(read_keyed(spark, path))


# ---------------------------------------------------------------- pairs (J12), anti/semi

NEG_SQL = f"""
WITH v AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS vacancy_id FROM supplier),
r0 AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS resume_id FROM customer),
r AS (SELECT resume_id, row_number() OVER (ORDER BY {R.hash_key('42', 'resume_id')}, resume_id) - 1 AS pos FROM r0),
nr AS (SELECT count(*) AS n FROM r),
m AS ({R.TRADE_PAIRS}),
mc AS (SELECT vacancy_id, count(*) AS m FROM m GROUP BY vacancy_id),
l AS (SELECT v.vacancy_id, {R.hash_int('42', 'v.vacancy_id')} % nr.n AS off,
             least(nr.n, coalesce(mc.m, 0) + 90) AS steps
      FROM v LEFT JOIN mc ON v.vacancy_id = mc.vacancy_id, nr),
w AS (SELECT vacancy_id, off, unnest(range(0, steps)) AS j FROM l),
c AS (SELECT w.vacancy_id, r.resume_id, w.j FROM w, nr, r WHERE r.pos = (w.off + w.j) % nr.n
      AND NOT EXISTS (SELECT 1 FROM m WHERE m.vacancy_id = w.vacancy_id AND m.resume_id = r.resume_id))
SELECT vacancy_id, resume_id, 0 AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY j) AS k FROM c) WHERE k <= 90
"""


@register("negative_pairs", NEG_SQL)
def q_negative_pairs(spark, d):
    """90 seeded non-matched résumés per vacancy."""
    vac = roles.vacancies(spark, d).select("vacancy_id")
    res = roles.resumes(spark, d).select("resume_id")
    return negative_pairs(vac, res, roles.trade_pairs(spark, d), 90, "vacancy_id", "resume_id", seed="42")


@register("missing_embeddings", """
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE trim(coalesce(d.text, '')) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
""")
def q_missing_embeddings(spark, d):
    """Rows with non-empty text and no vector yet."""
    docs = roles.table(spark, d, "documents").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    emb = roles.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return anti_join(docs, emb, "doc_id").select("doc_id", "lang", "n_chars")


@register("semi_lookup", """
SELECT d.doc_id, d.lang, d.n_chars FROM documents d
WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
""")
def q_semi_lookup(spark, d):
    """Rows whose id has a vector (semi join instead of IN batches)."""
    docs = roles.table(spark, d, "documents")
    emb = roles.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return semi_join(docs, emb, "doc_id").select("doc_id", "lang", "n_chars")


@register("missing_text_count", """
SELECT count(*) FILTER (WHERE coalesce(d.text, '') = '') AS n_empty, count(*) AS n_missing
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
""")
def q_missing_text_count(spark, d):
    """Rows without vectors, and how many of them have empty text."""
    docs = roles.table(spark, d, "documents")
    emb = roles.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return anti_join(docs, emb, "doc_id").agg(
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"), F.count(F.lit(1)).alias("n_missing"))


# ---------------------------------------------------------------- scalar features

_RATES_CASE = "CASE " + " ".join(
    "WHEN __cur = '" + s.replace("'", "''") + f"' THEN {r}" for s, r in T.CURRENCY_RATES) + " END"
_CUR_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s, _ in T.CURRENCY_RATES)

SALARY_SQL = f"""
WITH r AS ({R.RESUMES}),
t AS (SELECT resume_id, resume_salary_text AS txt,
             regexp_split_to_array(resume_salary_text, '[\\s\\x{{00A0}}]+') AS toks FROM r),
u AS (SELECT resume_id, txt,
             array_to_string(list_filter(toks, lambda x: regexp_full_match(x, '[0-9]+')), '') AS digits,
             list_filter(toks, lambda x: x IN ({_CUR_LIST}))[1] AS __cur FROM t),
x AS (SELECT resume_id, txt, digits, {_RATES_CASE} AS rate FROM u)
SELECT resume_id, txt AS resume_salary_text,
       round(CASE WHEN txt IS NULL OR txt = '' OR txt = 'NDT' OR digits = '' THEN 0.0
                  ELSE CAST(digits AS DOUBLE) * coalesce(rate, 1.0) END, 6) AS salary_rub,
       round(coalesce(CASE WHEN txt IS NULL OR txt = '' OR txt = 'NDT' OR digits = '' THEN 0.0
                  ELSE CAST(digits AS DOUBLE) * rate END, 0.0), 6) AS salary_rub_notebook
FROM x
"""


@register("salary_parse", SALARY_SQL)
def q_salary_parse(spark, d):
    """salary text → roubles (service rule and notebook rule)."""
    r = roles.resumes(spark, d)
    return r.select("resume_id", "resume_salary_text",
                    F.round(T.salary_to_rub("resume_salary_text"), 6).alias("salary_rub"),
                    F.round(F.coalesce(T.salary_to_rub("resume_salary_text", missing_rate=None), F.lit(0.0)), 6)
                     .alias("salary_rub_notebook"))


EXP_SQL = f"""
WITH p AS ({R.PERIOD_TEXTS}),
x AS (SELECT p_partkey, period_text,
        coalesce(TRY_CAST(nullif(regexp_extract(period_text, '(\\d+)\\s*год', 1), '') AS BIGINT), 0) * 12
      + coalesce(TRY_CAST(nullif(regexp_extract(period_text, '(\\d+)\\s*лет', 1), '') AS BIGINT), 0) * 12
      + coalesce(TRY_CAST(nullif(regexp_extract(period_text, '(\\d+)\\s*месяц', 1), '') AS BIGINT), 0) AS f6,
        CAST(coalesce(TRY_CAST(nullif(regexp_extract(period_text, '(?i)(\\d+)\\s*(год|лет|года)', 1), '') AS BIGINT), 0) * 12
      + coalesce(TRY_CAST(nullif(regexp_extract(period_text, '(?i)(\\d+)\\s*месяц', 1), '') AS BIGINT), 0) AS DOUBLE) AS f7
      FROM p)
SELECT p_partkey, period_text, CASE WHEN f6 > 0 THEN f6 END AS months,
       f7 AS months_single,
       CASE WHEN f6 IS NULL OR f6 <= 0 THEN '—' ELSE
         concat_ws(' ', CASE WHEN f6 // 12 > 0 THEN CAST(f6 // 12 AS VARCHAR) || ' г.' END,
                        CASE WHEN f6 % 12 > 0 THEN CAST(f6 % 12 AS VARCHAR) || ' мес.' END) END AS months_text
FROM x
"""


@register("experience_months", EXP_SQL)
def q_experience_months(spark, d):
    """Period text → months (two rule variants) → display text."""
    p = roles.period_texts(spark, d)
    m = T.experience_months("period_text")
    return p.select("p_partkey", "period_text", m.alias("months"),
                    T.experience_months_single("period_text").alias("months_single"),
                    T.months_to_text(m).alias("months_text"))


def _pair_frame(spark, d):
    return (roles.trade_pairs(spark, d)
            .join(roles.vacancies(spark, d), "vacancy_id")
            .join(roles.resumes(spark, d), "resume_id"))


_PAIRS_FROM = f"""
WITH v AS ({R.VACANCIES}), r AS ({R.RESUMES}), tp AS ({R.TRADE_PAIRS}),
pr AS (SELECT * FROM tp JOIN v USING (vacancy_id) JOIN r USING (resume_id))
"""

# F10 clean_text in DuckDB (the data has no characters outside these classes' semantics)
def _clean_sql(e: str) -> str:
    return (f"coalesce(trim(lower(regexp_replace(regexp_replace({e}, '[^а-яА-ЯёЁa-zA-Z0-9\\s]', ' ', 'g'), "
            f"'\\s+', ' ', 'g'))), '')")


@register("skill_count", _PAIRS_FROM + f"""
SELECT vacancy_id, resume_id,
  CAST(CASE WHEN vacancy_description IS NULL OR resume_skills IS NULL THEN 0 ELSE
    len(list_filter(resume_skills, lambda s: s IS NOT NULL AND s <> '' AND contains(vacancy_description, s))) END
    AS INTEGER) AS resume_skill_count_in_vacancy,
  CAST(len(list_filter(list_filter(list_transform(
        string_split_regex(regexp_replace(array_to_string(resume_skills, ', '), '[\\[\\]''"]', '', 'g'), '[,;\\n]'),
        lambda s: {_clean_sql('s')}), lambda s: length(s) > 2),
      lambda s: contains({_clean_sql('vacancy_description')}, s))) AS DOUBLE) AS skill_count_clean
FROM pr
""")
def q_skill_count(spark, d):
    """F14 (raw substring count) and F16 (cleaned variant) per trade pair."""
    # entity-side cleaning once per vacancy / résumé, then a cheap per-pair count
    vac = roles.vacancies(spark, d).select("vacancy_id", "vacancy_description",
                                           T.clean_text("vacancy_description").alias("__cd"))
    res = roles.resumes(spark, d).select("resume_id", "resume_skills",
                                         T.clean_skills(F.array_join("resume_skills", ", ")).alias("__cs"))
    j = roles.trade_pairs(spark, d).join(vac, "vacancy_id").join(res, "resume_id")
    clean = F.when(F.col("vacancy_description").isNull() | F.col("resume_skills").isNull(), F.lit(0.0)) \
             .otherwise(T.count_contained("__cs", "__cd").cast("double"))
    return j.select("vacancy_id", "resume_id",
                    T.skill_count("resume_skills", "vacancy_description").alias("resume_skill_count_in_vacancy"),
                    clean.alias("skill_count_clean"))


def _sw_sql() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words()) + "]"


def _simple_tokens_sql(e: str) -> str:
    return (f"list_filter(string_split({_clean_sql(e)}, ' '), "
            f"lambda t: length(t) > 2 AND NOT list_contains({_sw_sql()}, t))")


@register("position_share", _PAIRS_FROM + f"""
SELECT vacancy_id, resume_id, round(last_position_in_vacancy, 6) AS last_position_in_vacancy,
       round(position_token_share, 6) AS position_token_share FROM (
SELECT vacancy_id, resume_id,
  CASE WHEN resume_last_position IS NULL OR vacancy_description IS NULL
         OR len(list_filter(list_distinct(flatten([string_split(resume_last_position, ' '),
              string_split(resume_last_position, '-'), string_split(resume_last_position, '_')])), lambda w: w <> '')) = 0
       THEN 0.0
       ELSE len(list_filter(list_filter(list_distinct(flatten([string_split(resume_last_position, ' '),
              string_split(resume_last_position, '-'), string_split(resume_last_position, '_')])), lambda w: w <> ''),
              lambda w: contains(vacancy_description, w)))
          / len(list_filter(list_distinct(flatten([string_split(resume_last_position, ' '),
              string_split(resume_last_position, '-'), string_split(resume_last_position, '_')])), lambda w: w <> ''))
  END AS last_position_in_vacancy,
  CASE WHEN vacancy_description IS NULL OR resume_last_position IS NULL
         OR len({_simple_tokens_sql('resume_last_position')}) = 0 THEN 0.0
       ELSE len(list_filter({_simple_tokens_sql('resume_last_position')},
                lambda t: list_contains({_simple_tokens_sql('vacancy_description')}, t)))
            / len({_simple_tokens_sql('resume_last_position')}) END AS position_token_share
FROM pr)
""")
def q_position_share(spark, d):
    """F17 (substring share of position words) and F18 (token share)."""
    sw = list(default_stop_words())
    # tokens and word sets once per entity; pairs only do set lookups
    vac = roles.vacancies(spark, d).select("vacancy_id", "vacancy_description",
                                           T.token_set("vacancy_description", sw).alias("__vt"))
    res = roles.resumes(spark, d).select("resume_id", "resume_last_position",
                                         T.simple_tokens("resume_last_position", sw).alias("__pt"),
                                         T.position_words("resume_last_position").alias("__pw"))
    j = roles.trade_pairs(spark, d).join(vac, "vacancy_id").join(res, "resume_id")
    share = F.when(F.col("resume_last_position").isNull() | F.col("vacancy_description").isNull()
                   | (F.size("__pw") == 0), F.lit(0.0)) \
             .otherwise(T.count_contained("__pw", "vacancy_description") / F.size("__pw"))
    tok = F.when(F.col("vacancy_description").isNull() | F.col("resume_last_position").isNull(), F.lit(0.0)) \
           .otherwise(T.token_share("__vt", "__pt"))
    return j.select("vacancy_id", "resume_id", F.round(share, 6).alias("last_position_in_vacancy"),
                    F.round(tok, 6).alias("position_token_share"))


@register("location_match", _PAIRS_FROM + f"""
SELECT vacancy_id, resume_id,
  CASE WHEN vacancy_area = resume_location THEN 1 ELSE 0 END AS location_matching,
  CAST(CASE WHEN vacancy_area IS NULL OR resume_location IS NULL THEN 0.0
       WHEN ({_clean_sql('vacancy_area')} = {_clean_sql('resume_location')}
             OR contains({_clean_sql('vacancy_area')}, {_clean_sql('resume_location')})
             OR contains({_clean_sql('resume_location')}, {_clean_sql('vacancy_area')}))
            AND {_clean_sql('vacancy_area')} <> '' AND {_clean_sql('resume_location')} <> '' THEN 1.0
       ELSE 0.0 END AS DOUBLE) AS location_match_clean
FROM pr
""")
def q_location_match(spark, d):
    """F12 (exact) and F13 (cleaned containment) per trade pair."""
    vac = roles.vacancies(spark, d).select("vacancy_id", "vacancy_area", T.clean_text("vacancy_area").alias("__ca"))
    res = roles.resumes(spark, d).select("resume_id", "resume_location", T.clean_text("resume_location").alias("__cl"))
    j = roles.trade_pairs(spark, d).join(vac, "vacancy_id").join(res, "resume_id")
    return j.select("vacancy_id", "resume_id",
                    T.location_match("vacancy_area", "resume_location").alias("location_matching"),
                    T.contains_either("vacancy_area", "resume_location", "__ca", "__cl").alias("location_match_clean"))


def _lower_trim(e):
    return f"trim(lower(coalesce({e}, '')))"


@register("category_rules", f"""
WITH v AS ({R.VACANCIES})
SELECT vacancy_id, vacancy_experience_raw, vacancy_employment_raw, vacancy_schedule_raw,
  CASE WHEN contains({_lower_trim('vacancy_experience_raw')}, 'нет') OR contains({_lower_trim('vacancy_experience_raw')}, 'не треб') THEN 'Нет опыта'
       WHEN contains({_lower_trim('vacancy_experience_raw')}, '1') AND (contains({_lower_trim('vacancy_experience_raw')}, '3') OR contains({_lower_trim('vacancy_experience_raw')}, 'год')) THEN 'От 1 года до 3 лет'
       WHEN contains({_lower_trim('vacancy_experience_raw')}, '3') AND (contains({_lower_trim('vacancy_experience_raw')}, '6') OR contains({_lower_trim('vacancy_experience_raw')}, 'лет')) THEN 'От 3 до 6 лет'
       WHEN contains({_lower_trim('vacancy_experience_raw')}, '6') OR contains({_lower_trim('vacancy_experience_raw')}, 'более') OR contains({_lower_trim('vacancy_experience_raw')}, 'свыше') THEN 'Более 6 лет'
       ELSE 'Нет опыта' END AS vacancy_experience,
  CASE WHEN contains(lower(coalesce(vacancy_employment_raw, '')), 'частич') THEN 'Частичная занятость'
       WHEN contains(lower(coalesce(vacancy_employment_raw, '')), 'проект') OR contains(lower(coalesce(vacancy_employment_raw, '')), 'разовое') THEN 'Проектная работа'
       ELSE 'Полная занятость' END AS vacancy_employment,
  CASE WHEN contains(lower(coalesce(vacancy_schedule_raw, '')), 'удал') THEN 'Удаленная работа'
       WHEN contains(lower(coalesce(vacancy_schedule_raw, '')), 'гибк') THEN 'Гибкий график'
       WHEN contains(lower(coalesce(vacancy_schedule_raw, '')), 'сменн') THEN 'Сменный график'
       WHEN contains(lower(coalesce(vacancy_schedule_raw, '')), 'вахт') THEN 'Вахтовый метод'
       ELSE 'Полный день' END AS vacancy_schedule
FROM v
""")
def q_category_rules(spark, d):
    """Ordered substring rules → experience / employment / schedule."""
    v = roles.vacancies(spark, d)
    return v.select("vacancy_id", "vacancy_experience_raw", "vacancy_employment_raw", "vacancy_schedule_raw",
                    T.normalize_experience("vacancy_experience_raw").alias("vacancy_experience"),
                    T.normalize_employment("vacancy_employment_raw").alias("vacancy_employment"),
                    T.normalize_schedule("vacancy_schedule_raw").alias("vacancy_schedule"))


# ---------------------------------------------------------------- cleaning

@register("clean_clip", f"""
WITH n AS ({R.NUMERIC_PROFILE}),
c AS (SELECT resume_id,
        CASE WHEN resume_salary IS NULL OR resume_salary < 0 OR resume_salary > 10000000 THEN 0.0 ELSE resume_salary END AS resume_salary,
        greatest(least(coalesce(resume_age, 30.0), 90.0), 18.0) AS resume_age,
        greatest(least(coalesce(resume_experience_months, 0.0), 720.0), 0.0) AS resume_experience_months,
        greatest(least(coalesce(resume_last_company_experience_months, 0.0), 720.0), 0.0) AS resume_last_company_experience_months
      FROM n)
SELECT resume_id, round(resume_salary, 6) AS resume_salary, resume_age, resume_experience_months,
       least(resume_last_company_experience_months, resume_experience_months) AS resume_last_company_experience_months
FROM c
""")
def q_clean_clip(spark, d):
    """Batch cleaning chain."""
    n = roles.numeric_profile(spark, d).drop("segment")
    out = C.clean_batch(n)
    return out.select("resume_id", F.round("resume_salary", 6).alias("resume_salary"), "resume_age",
                      "resume_experience_months", "resume_last_company_experience_months")


@register("consistency_filter", f"""
WITH n AS ({R.NUMERIC_PROFILE}),
m AS (SELECT avg(resume_age) AS a FROM n),
i AS (SELECT resume_id, resume_salary, coalesce(resume_age, m.a) AS resume_age,
             resume_experience_months, resume_last_company_experience_months FROM n, m),
f AS (SELECT * FROM i WHERE coalesce(resume_salary <= 10000000, true)),
g AS (SELECT resume_id, resume_salary, resume_age,
             CASE WHEN resume_experience_months > 720 THEN 720.0 ELSE resume_experience_months END AS resume_experience_months,
             resume_last_company_experience_months FROM f)
SELECT resume_id, round(resume_salary, 6) AS resume_salary, round(resume_age, 6) AS resume_age,
       resume_experience_months, resume_last_company_experience_months
FROM g
WHERE NOT coalesce(resume_last_company_experience_months > resume_experience_months, false)
  AND NOT coalesce(resume_age < floor(resume_experience_months / 12) + 16, false)
  AND NOT coalesce(resume_age > 90, false)
""")
def q_consistency_filter(spark, d):
    """P7 → P9 → P10 → P11 in the reference's order."""
    n = roles.numeric_profile(spark, d).drop("segment")
    out = (C.impute_mean(n, "resume_age")
           .transform(lambda x: C.outlier_filter(x, "resume_salary", 1e7, keep_null=True))
           .transform(lambda x: C.cap(x, "resume_experience_months", 720.0))
           .transform(lambda x: C.consistency_filter(x, "resume_age", "resume_experience_months",
                                                     "resume_last_company_experience_months")))
    return out.select("resume_id", F.round("resume_salary", 6).alias("resume_salary"),
                      F.round("resume_age", 6).alias("resume_age"), "resume_experience_months",
                      "resume_last_company_experience_months")

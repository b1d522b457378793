"""DuckDB SQL for the domain roles of ``pairmill.sources.roles``.

Each constant is a CTE body over the driver's pre-registered views, written
to give exactly the rows the Spark role functions give.
"""

from ..functions.text import CURRENCY_RATES

VACANCIES = """
  SELECT CAST(s.s_suppkey AS VARCHAR) AS vacancy_id, s.s_name AS vacancy_name,
         n.n_name AS vacancy_area,
         concat_ws(' ', s.s_name, p.p_name, p.p_type, p.p_brand, c.c_mktsegment,
                   CASE WHEN p.p_size % 7 = 0 THEN 'Customer care' END) AS vacancy_description,
         concat_ws(' ', (['от', 'более', 'свыше', 'не требуется', 'нет'])[p.p_size % 5 + 1],
                   CAST(p.p_size % 8 AS VARCHAR), (['года', 'лет'])[p.p_partkey % 2 + 1]) AS vacancy_experience_raw,
         (['полная занятость', 'Частичная занятость', 'проектная работа', 'разовое задание', 'стажировка'])[p.p_size % 5 + 1]
           AS vacancy_employment_raw,
         (['полный день', 'Удаленная работа', 'гибкий график', 'сменный график', 'вахтовый метод', '5/2'])[p.p_partkey % 6 + 1]
           AS vacancy_schedule_raw
  FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN part p ON p.p_partkey = s.s_suppkey
  LEFT JOIN customer c ON c.c_custkey = s.s_suppkey
"""

_CUR = "[" + ", ".join("'" + sym.replace("'", "''") + "'" for sym, _ in CURRENCY_RATES) + ", '']"

SALARY_TEXT = f"""
  CASE WHEN ({_CUR})[(c.c_nationkey % 10) + 1] = '' THEN __num
       ELSE __num || ' ' || ({_CUR})[(c.c_nationkey % 10) + 1] END
"""

RESUMES = f"""
  SELECT CAST(c.c_custkey AS VARCHAR) AS resume_id, n.n_name AS resume_location,
         CASE WHEN c.c_custkey % 11 = 0 THEN [c.c_mktsegment, '', 'Brand#' || CAST(c.c_nationkey AS VARCHAR)]
              WHEN c.c_custkey % 5 = 0 THEN [c.c_mktsegment, 'Brand#' || CAST(c.c_nationkey AS VARCHAR), c.c_mktsegment]
              ELSE [c.c_mktsegment, 'Brand#' || CAST(c.c_nationkey AS VARCHAR)] END AS resume_skills,
         replace(c.c_name, '#', ' ') AS resume_last_position,
         {SALARY_TEXT.replace('__num', '''(CASE WHEN c.c_custkey % 3 = 0 AND CAST(floor(c.c_acctbal) AS BIGINT) >= 1000
                THEN CAST(CAST(floor(c.c_acctbal) AS BIGINT) // 1000 AS VARCHAR) || chr(160) ||
                     lpad(CAST(CAST(floor(c.c_acctbal) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
                ELSE CAST(CAST(floor(c.c_acctbal) AS BIGINT) AS VARCHAR) END)''')} AS resume_salary_text,
         c.c_acctbal AS resume_acctbal, c.c_custkey
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

TRADE_PAIRS = """
  SELECT DISTINCT CAST(l.l_suppkey AS VARCHAR) AS vacancy_id, CAST(o.o_custkey AS VARCHAR) AS resume_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def hash_unit(seed: str, col: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({col} AS VARCHAR)), 1, 8))::BIGINT / 4294967295.0)"


def hash_int(seed: str, col: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({col} AS VARCHAR)), 1, 8))::BIGINT)"


def hash_key(seed: str, col: str) -> str:
    return f"md5('{seed}|' || CAST({col} AS VARCHAR))"


DECISIONS = f"""
  SELECT d.doc_id, d.source AS group_id, d.lang, d.n_chars, l.toxic,
         CAST(l.quality AS INTEGER) AS target,
         round({hash_unit('score', 'd.doc_id')}, 6) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

SERVICE_LOG = """
  SELECT event_id AS id, ts AS created_at, CAST(user_id AS VARCHAR) AS resume_id, event_type,
         value AS processing_time, CAST(event_type = 'purchase' AS INTEGER) AS prediction,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
"""

SNAPSHOTS = """
  SELECT CAST(user_id AS VARCHAR) AS id, event_type AS source, date_trunc('day', ts) AS parsed_date,
         event_id, value, ts
  FROM events
"""

# F14 / F17 / F12 on a joined pair row (columns of VACANCIES and RESUMES)
PAIR_FEATURES = """
  CASE WHEN v.vacancy_area = r.resume_location THEN 1 ELSE 0 END AS location_matching,
  CASE WHEN v.vacancy_description IS NULL OR r.resume_skills IS NULL THEN 0 ELSE
    len(list_filter(r.resume_skills, lambda s: s IS NOT NULL AND s <> '' AND contains(v.vacancy_description, s))) END
    AS resume_skill_count_in_vacancy,
  CASE WHEN r.resume_last_position IS NULL OR v.vacancy_description IS NULL
         OR len(list_filter(list_distinct(flatten([string_split(r.resume_last_position, ' '),
                  string_split(r.resume_last_position, '-'), string_split(r.resume_last_position, '_')])),
                  lambda w: w <> '')) = 0 THEN 0.0
       ELSE len(list_filter(list_filter(list_distinct(flatten([string_split(r.resume_last_position, ' '),
                  string_split(r.resume_last_position, '-'), string_split(r.resume_last_position, '_')])),
                  lambda w: w <> ''), lambda w: contains(v.vacancy_description, w)))
            / len(list_filter(list_distinct(flatten([string_split(r.resume_last_position, ' '),
                  string_split(r.resume_last_position, '-'), string_split(r.resume_last_position, '_')])),
                  lambda w: w <> ''))
  END AS last_position_in_vacancy
"""

NUMERIC_PROFILE = """
  SELECT CAST(c_custkey AS VARCHAR) AS resume_id, c_acctbal * 1500 AS resume_salary,
         CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 16 + c_custkey % 80 END AS DOUBLE) AS resume_age,
         CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 7) % 900 END AS DOUBLE) AS resume_experience_months,
         CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey * 13) % 800 END AS DOUBLE)
           AS resume_last_company_experience_months,
         c_mktsegment AS segment
  FROM customer
"""

PERIOD_TEXTS = """
  SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'нет' ELSE
    CAST(p_size AS VARCHAR) || CASE WHEN p_size % 10 = 1 THEN ' год ' WHEN p_size % 10 IN (2, 3, 4) THEN ' года '
                                    ELSE ' лет ' END || CAST(p_partkey % 12 AS VARCHAR) || ' месяцев' END AS period_text
  FROM part
"""

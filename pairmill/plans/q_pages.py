"""Entity rows from landed pages (S17, S18, UDF4 with F22, F25-F37).

The landed pages are written from the domain tables by columns; what is parsed
from them must be what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import labelled_field
from ..sources import entities, roles
from . import oracle_roles
from .catalog import register


def _esc(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _html(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def vacancy_pages(spark: SparkSession, d: str) -> DataFrame:
    """A detail page a vacancy, with tags in a script, open paragraphs and list items, and references."""
    v = roles.vacancies(spark, d)
    return v.select("vacancy_id", _html(
        "<!DOCTYPE html><html><head><title>", _esc("vacancy_name"), " &mdash; работа в компании ", _esc("vacancy_name"), " на SuperJob</title>",
        '<script>if (1 < 2) { t = "<h1>no heading</h1><main>"; }</script></head><body><nav><ul><li><a href="/vacancies">Вакансии<li>',
        '<a href="/resumes">Резюме</ul></nav><main><h1 class="big title">\n ', _esc("vacancy_name"), ' </h1><div><span class="area">', _esc("vacancy_area"),
        "</span></b><p>Требуемый опыт: <b>", _esc("vacancy_experience_raw"), "</b><p>Занятость:&nbsp;", _esc("vacancy_employment_raw"), "<br>График: <i>",
        _esc("vacancy_schedule_raw"), "</p></div><p>Обязанности: ", _esc("vacancy_description"),
        "<ul><li>Требования: &lt;опыт&gt;<li>Условия: офис</ul></main><footer>&copy; SuperJob</footer></body>").alias("html"))


@register("vacancy_detail", f"""
SELECT vacancy_id, vacancy_name AS employer, vacancy_name, coalesce(vacancy_area, '') AS vacancy_area,
       coalesce(vacancy_experience_raw, '') AS experience, coalesce(vacancy_employment_raw, '') AS employment,
       coalesce(vacancy_schedule_raw, '') AS schedule, vacancy_description AS duties, '<опыт>' AS requirements
FROM ({oracle_roles.VACANCIES})
""")
def q_vacancy_detail(spark: SparkSession, d: str) -> DataFrame:
    """S17/UDF4/F25/F26/F28: one typed row a vacancy page."""
    rows = entities.entity_rows(vacancy_pages(spark, d), entities.vacancy_page, entities.VACANCY)
    field = lambda label: labelled_field("body", label + r":[\s]*([^\n]*)")
    return rows.select(
        "vacancy_id", parse.employer_from_title("title").alias("employer"), F.col("name").alias("vacancy_name"), F.col("area").alias("vacancy_area"),
        field("Требуемый опыт").alias("experience"), field("Занятость").alias("employment"), field("График").alias("schedule"),
        parse.section("body", ["Должностные обязанности", "Обязанности"]).alias("duties"), field("Требования").alias("requirements"))


def resume_list_pages(spark: SparkSession, d: str, per_page: int = 25) -> DataFrame:
    """List pages of ``per_page`` cards; the first card of a page stands there twice, and there is a link that is no profile."""
    r = roles.resumes(spark, d)
    item = F.array_join(F.transform(F.col("resume_skills"), lambda s: F.concat(F.lit("<li>"), _esc(s))), "")
    card = _html('<div class="card resume-card"><a class="title" href="/r', F.lpad("resume_id", 9, "0"), '">', _esc("resume_last_position"),
                 "</a><br><span class=salary>", _esc("resume_salary_text"), '</span> <span class="area">', _esc("resume_location"), "</span><ul>", item, "</ul></div>")
    cards = r.select(F.floor(F.col("c_custkey") / per_page).alias("page"), F.struct("c_custkey", card.alias("card")).alias("x"))
    sheets = cards.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["card"]).alias("cards"))  # per_page cards
    other = '<div class="resume-card"><a class="title" href="/vacancies">Вакансии</a></div><div class="resume-card">no link</div>'
    return sheets.select("page", _html("<html><body><nav><a href=/r1>x</a></nav><div>", F.array_join("cards", "\n"), F.element_at("cards", 1), other,
                                       "</div></div></body>").alias("html"))


@register("resume_cards", f"""
SELECT '/r' || lpad(resume_id, 9, '0') AS href, CAST(c_custkey // 25 AS BIGINT) AS page, resume_last_position AS position,
       replace(resume_salary_text, chr(160), ' ') AS salary_text, coalesce(resume_location, '') AS area,
       CAST(len(list_filter(resume_skills, lambda s: s <> '')) AS INTEGER) AS n_skills,
       array_to_string(list_filter(resume_skills, lambda s: s <> ''), '|') AS skills
FROM ({oracle_roles.RESUMES})
""")
def q_resume_cards(spark: SparkSession, d: str) -> DataFrame:
    """S18/UDF4/F22: list pages to one row a card, each profile link once."""
    rows = entities.entity_rows(resume_list_pages(spark, d), entities.resume_list, entities.CARD)
    # one row a link; the same card twice has equal values
    one = rows.filter(parse.is_profile_link("href")).dropDuplicates(["href"])
    return one.select("href", "page", "position", "salary_text", "area", F.size("skills").alias("n_skills"), F.array_join("skills", "|").alias("skills"))


#: pages that one task parses
PAGES_A_TASK = 10_000
#: levels of the profiles, by customer number
LEVELS = ["Lead", "Senior", "Middle", "Junior"]


def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    """A profile page a customer, with sections by heading and a JSON state in a script."""
    c = roles.table(spark, d, "customer")
    # rows are short and pages long to parse: tasks by rows, not by the bytes of the file
    c = c.repartition(max(spark.sparkContext.defaultParallelism, -(-c.count() // PAGES_A_TASK)), "c_custkey")
    n = roles.table(spark, d, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))
    nation, segment = F.coalesce("n_name", F.lit("X")), F.col("c_mktsegment")
    state = F.to_json(F.struct(
        F.struct(F.array(F.struct(segment.alias("string")), F.struct(F.lit("").alias("string"))).alias("value")).alias("keySkills"),
        F.struct(F.array(F.struct(F.lit("Institute").alias("organization"), nation.alias("faculty"), F.lit("2010").alias("year"))).alias("value")).alias("primaryEducation"),
        F.struct(F.array(F.struct(F.lit("School").alias("organization"), segment.alias("name"), F.lit("").alias("year"))).alias("value")).alias("attestationEducation"),
        F.struct(F.struct(nation.alias("title")).alias("value")).alias("area")))
    return j.select(F.col("c_custkey").alias("profile_id"), _html(
        "<html><head><title>t</title></head><body><div>Хабр Карьера<h2>", _esc("c_name"), "</h2>Обновлено сегодня<p>Analyst<p>", _esc(segment),
        "</p><div>", of(parse.STATUS_PHRASES), "</div><p>", of(LEVELS), "<p>от&nbsp;", F.abs(F.floor("c_acctbal")).cast("string"), " ₽<h3>Возраст</h3><p>",
        (F.col("c_custkey") % 40 + 20).cast("string"), " лет<h3>Опыт работы</h3><table><tr><td>Company ", _esc(nation), "<td>Минск<tr><td>Head of ", _esc(segment),
        "</table><p>Май 2019 — Настоящее время<p>3 года и 2 месяца<p>Built &amp; ran<h3>Образование</h3><ul><li>/x<li>University of ", _esc(nation),
        "</ul><h3>Навыки</h3><span>", _esc(segment), "</span><br>Выберите навык<br>C++<br>a&amp;b<h3>Обо мне</h3><p>Likes ", _esc(segment), "<br>a lot",
        '<script id="state" type="application/json">', state, "</script></div></body>").alias("html"))


@register("profile_rows", """
WITH j AS (SELECT c_custkey, c_name, c_mktsegment AS seg, coalesce(n_name, 'X') AS nat, abs(CAST(floor(c_acctbal) AS BIGINT)) AS bal
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS profile_id, c_name AS name, 'Analyst ' || seg AS title,
  (['Ищу работу', 'Рассматриваю предложения', 'Не ищу работу'])[c_custkey % 3 + 1] AS status,
  (['Lead', 'Senior', 'Middle', 'Junior'])[c_custkey % 4 + 1] AS level, 'от ' || bal || ' ₽' AS salary, CAST(c_custkey % 40 + 20 AS INTEGER) AS age,
  '3 года и 2 месяца' AS experience, 'Company ' || nat AS company, 'Head of ' || seg AS position, 'Май 2019 — Настоящее время' AS period,
  '3 года и 2 месяца Built & ran' AS job_text, 'University of ' || nat AS education, seg || '|C++' AS skills, 'Likes ' || seg || ' a lot' AS about,
  seg AS state_skills, 'Institute ' || nat || ' (2010)' AS state_education, 'School ' || seg AS state_courses, nat AS state_area
FROM j
""")
def q_profile_rows(spark: SparkSession, d: str) -> DataFrame:
    """S17/UDF4 with F30-F37: profile pages to one row of all extracted fields."""
    rows = entities.entity_rows(profile_pages(spark, d), entities.profile_page, entities.PROFILE)
    x = rows.withColumn("ls", parse.lines("body")).withColumn("job", parse.last_experience("ls")).withColumn("st", parse.json_state("state"))
    return x.select(
        "profile_id", "name", parse.title_from_lines("ls", "name").alias("title"), parse.status("body").alias("status"), parse.level("body").alias("level"),
        parse.salary_phrase("body").alias("salary"), parse.age_from_lines("ls").alias("age"), parse.experience_line("ls").alias("experience"),
        *[F.col(f"job.{a}").alias(b) for a, b in (("company", "company"), ("position", "position"), ("period", "period"), ("description", "job_text"))],
        parse.education("ls").alias("education"), F.array_join(parse.skills_section("ls"), "|").alias("skills"), parse.about_section("ls").alias("about"),
        *[F.array_join(f"st.{c}", "|").alias(f"state_{c}") for c in ("skills", "education", "courses")], F.col("st.area").alias("state_area"))

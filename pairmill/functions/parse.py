"""Text extractors for landed profile / vacancy pages (F22, F26-F28, F30-F37,
F46, F47).  Pages are split into lines (``split(text, '\\n')``) and scanned
with array functions; the work-history state machine (F35) is an
``aggregate`` over the lines with a struct accumulator — all JVM-side, no
per-row Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (do not edit):
#   paths that are not profile links, and path prefixes that are not either
EXCLUDED_PATHS = ["/vacancies", "/resumes", "/experts", "/companies", "/salaries", "/education", "/journal",
                  "/info", "/catalog", "/sitemap", "/feedback", "/price", "/universities", "/education_centers",
                  "/users", "/rating", "/ratings"]
EXCLUDED_PREFIXES = ["/companies/", "/universities/", "/education_centers/", "/vacancies/", "/journal/",
                     "/catalog/", "/info/", "/experts/", "/salaries/", "/education/", "/users/", "/rating"]
#   job-search status phrases, in priority order
STATUS_PHRASES = ["Ищу работу", "Рассматриваю предложения", "Не ищу работу"]
#   section headings / stop lines
EXPERIENCE_END = ["Образование", "Навыки", "Обо мне", "Рекомендательные письма", "Хабр Карьера", "О сервисе"]
SKILLS_END = ["Опыт работы", "Образование", "Обо мне", "Рекомендательные письма", "Друзья"]
#   a card's title ends here, as does its description snippet
TITLE_END = ["Ищу работу", "Рассматриваю предложения", "Не ищу работу", "Профессиональные навыки", "Возраст",
             "Опыт работы", "Написать на Хабре", "Написать", "Войти", "•", ""]
SNIPPET_END = ["Образование", "Профессиональные навыки", "Добавить в избранное", "Открыть контакты", "Написать",
               "Хабр Карьера"]
LEVEL_LINE = r"^(Lead|Senior|Middle|Junior|Ведущий|Старший|Средний|Младший)$"
SNIPPET_SKIP = r"(?iU)^\d+\s+компани|\d+\s*(лет|год|года|месяц)|^•$"
SKILLS_NOISE = ["Выберите навык", "чтобы посмотреть"]
ABOUT_END = ["Навыки", "Опыт работы", "Образование", "Рекомендательные письма"]
EDUCATION_NOISE = ["Хабр Карьера", "О сервисе", "Услуги и цены", "Журнал", "Каталог вакансий", "Каталог курсов",
                   "Карта сайта", "Контакты", "Отзывы об онлайн-школах", "Рейтинг школ", "Промокоды и скидки",
                   "Для соискателя", "Для работодателя", "API сервиса", "Служба поддержки",
                   "Следите за нами в соцсетях"]
#   patterns
PROFILE_LINK = r"^/[a-zA-Z][a-zA-Z0-9_-]{2,}$"
LEVEL_RU = r"(?iU)(Ведущий|Старший|Средний|Младший)\s*\(?\s*(?:Lead|Senior|Middle|Junior)?\s*\)?"
LEVEL_EN = r"(?iU)\b(Lead|Senior|Middle|Junior)\b"
SALARY_PHRASE = r"(?iU)((?:от|до)\s*[\d\s]+₽|[\d\s]{5,}₽)"
AGE_BLOCK = r"(?U)Возраст:\s*\n+(\d+)\s+(?:лет|год|года)"
PERIOD = r"^[А-Я][а-я]+\s+\d{4}\s*[—–-]\s*(?:[А-Я][а-я]+\s+\d{4}|[Нн]астоящее)"
CITY = r"^[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?$"
SKILL_LINE = r"^[A-Za-zА-Яа-яёЁ0-9.#+\-\s/]{2,40}$"
EMPLOYER_IN_TITLE = r"(?iU)работа в компании\s+([^(,\n]+?)(?:\s*[,(—|]|\s+на\s+SuperJob|$)"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lines(text) -> Column:
    """Non-empty, trimmed lines of a page text."""
    return F.filter(F.transform(F.split(_c(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def is_profile_link(href) -> Column:
    """profile-link predicate (pattern minus excluded paths/prefixes)."""
    h = _c(href)
    pref = F.exists(_arr(EXCLUDED_PREFIXES), lambda p: h.startswith(p))
    return F.coalesce(h.rlike(PROFILE_LINK) & ~h.isin(*EXCLUDED_PATHS) & ~pref, F.lit(False))


def employer_from_title(title) -> Column:
    """employer name from a page title, trailing punctuation removed."""
    v = F.regexp_extract(_c(title), EMPLOYER_IN_TITLE, 1)
    return F.regexp_replace(F.trim(v), r"[ ,.\-—]+$", "")


def first_known(text, names: list[str]) -> Column:
    """first name of a dimension (e.g. city list) found in the text."""
    alt = "|".join(re.escape(n) for n in sorted({n for n in names if n}, key=lambda x: (-len(x), x)))
    return F.regexp_extract(_c(text), "(" + alt + ")", 1) if alt else F.lit("")


def section(text, markers: list[str], limit: int | None = None) -> Column:
    """text after the first marker up to the next 'Heading:' line (its
    first ``limit`` characters if given); '' when no marker is found."""
    out = None
    for mk in markers:
        pat = "(?isU)" + mk + r"[:\s]*(.*?)(?=\n[А-ЯЁ][^\n]{3,}:|\z)"
        v = F.trim(F.regexp_extract(_c(text), pat, 1))
        v = F.when(_c(text).rlike(pat), v if limit is None else F.substring(v, 1, limit))
        out = v if out is None else F.coalesce(out, v)
    return F.coalesce(out, F.lit("")) if out is not None else F.lit("")


def level(text) -> Column:
    """seniority phrase (Russian form first, then the English word)."""
    t = _c(text)
    ru = F.regexp_extract(t, LEVEL_RU, 0)
    en = F.regexp_extract(t, LEVEL_EN, 0)
    return F.trim(F.when(ru != "", ru).otherwise(en))


def status(text) -> Column:
    """first status phrase present, '' if none."""
    t = _c(text)
    out = None
    for ph in STATUS_PHRASES:
        out = F.when(F.contains(t, F.lit(ph)), F.lit(ph)) if out is None else out.when(F.contains(t, F.lit(ph)), F.lit(ph))
    return out.otherwise(F.lit(""))


def salary_phrase(text) -> Column:
    """F32: salary phrase ('от 200 000 ₽')."""
    return F.trim(F.regexp_extract(_c(text), SALARY_PHRASE, 1))


def age_from_block(text) -> Column:
    """F32: age after a 'Возраст:' line; null if absent."""
    v = F.regexp_extract(_c(text), AGE_BLOCK, 1)
    return F.when(v != "", v.cast("int"))


def _after(ls: Column, marker: str) -> Column:
    """Lines following the first line equal to ``marker`` (empty if none)."""
    pos = F.array_position(ls, F.lit(marker))
    return F.when(pos > 0, F.slice(ls, (pos + 1).cast("int"), F.size(ls))).otherwise(F.array().cast("array<string>"))


def _until(ls: Column, stops: list[str]) -> Column:
    """Prefix of ``ls`` before the first stop line."""
    idx = F.array_position(F.transform(ls, lambda s: F.array_contains(_arr(stops), s)), F.lit(True))
    return F.when(idx > 0, F.slice(ls, 1, (idx - 1).cast("int"))).otherwise(ls)


def age_from_lines(ls) -> Column:
    """first number on the line after 'Возраст'."""
    nxt = F.try_element_at(_after(_c(ls), "Возраст"), F.lit(1))
    v = F.regexp_extract(nxt, r"(\d+)", 1)
    return F.when(v != "", v.cast("int"))


def experience_line(ls) -> Column:
    """first line after 'Опыт работы', before the next section, naming
    years/months."""
    w = _until(_after(_c(ls), "Опыт работы"), EXPERIENCE_END)
    return F.coalesce(F.try_element_at(F.filter(w, lambda s: s.rlike(r"(?iU)лет|год|месяц")), F.lit(1)), F.lit(""))


def skills_section(ls) -> Column:
    """skill lines after 'Навыки' up to the next section."""
    w = _until(_after(_c(ls), "Навыки"), SKILLS_END)
    return F.filter(w, lambda s: s.rlike(SKILL_LINE) & ~F.array_contains(_arr(SKILLS_NOISE), s))


def about_section(ls) -> Column:
    """'Обо мне' text up to the next section."""
    return F.array_join(_until(_after(_c(ls), "Обо мне"), ABOUT_END), " ")


def title_from_lines(ls, name) -> Column:
    """title of a card: the lines after the one equal to ``name`` and the
    date line below it, up to a status, level, salary or section line."""
    start = F.array_position(_c(ls), _c(name))
    w = F.when(start > 0, F.slice(_c(ls), (start + 2).cast("int"), F.size(_c(ls)))) \
         .otherwise(F.array().cast("array<string>"))
    ends = F.transform(w, lambda s: F.array_contains(_arr(TITLE_END), s) | s.rlike(LEVEL_LINE) | F.contains(s, F.lit("₽")))
    idx = F.array_position(ends, F.lit(True))
    kept = F.when(idx > 0, F.slice(w, 1, (idx - 1).cast("int"))).otherwise(w)
    return F.trim(F.array_join(F.filter(kept, lambda s: F.length(s) > 1), " "))


def description_snippet(ls) -> Column:
    """the card's text after 'Опыт работы' up to the next section,
    without counts of companies or years and lines of 5 characters or fewer."""
    w = _until(_after(_c(ls), "Опыт работы"), SNIPPET_END)
    return F.trim(F.array_join(F.filter(w, lambda s: ~s.rlike(SNIPPET_SKIP) & (F.length(s) > 5)), " "))


def last_experience(ls) -> Column:
    """(company, position, period, description) of the first job after
    'Опыт работы' — the reference's line state machine as an ``aggregate``
    over the following lines up to the next section."""
    w = _until(_after(_c(ls), "Опыт работы"), EXPERIENCE_END)
    empty = F.array().cast("array<string>")
    init = F.struct(F.lit(False).alias("stop"), F.lit("").alias("company"), F.lit("").alias("position"),
                    F.lit("").alias("period"), F.lit(False).alias("in_desc"), empty.alias("desc"))

    def step(a, line):
        def upd(**kw):
            cols = {k: a[k] for k in ("stop", "company", "position", "period", "in_desc", "desc")}
            cols.update(kw)
            return F.struct(*[v.alias(k) for k, v in cols.items()])
        is_period = line.rlike(PERIOD)
        return (F.when(a["stop"], a)
                 .when(F.array_contains(_arr(EXPERIENCE_END), line), upd(stop=F.lit(True)))
                 .when(a["company"] == "", upd(company=line))
                 .when((a["position"] == "") & ~is_period,
                       F.when(line.rlike(CITY), a).when(F.length(line) > 3, upd(position=line)).otherwise(a))
                 .when(is_period, upd(period=line, in_desc=F.lit(True)))
                 .when(a["in_desc"], upd(desc=F.concat(a["desc"], F.array(line))))
                 .otherwise(a))

    r = F.aggregate(w, init, step)
    return F.struct(r["company"].alias("company"), r["position"].alias("position"), r["period"].alias("period"),
                    F.array_join(r["desc"], " ").alias("description"))


def education(ls) -> Column:
    """first plausible institution line after 'Образование', before the
    next section."""
    w = _until(_after(_c(ls), "Образование"), ["Навыки", "Опыт работы", "Обо мне", "Рекомендательные письма"])
    ok = F.filter(w, lambda s: ~F.array_contains(_arr(EDUCATION_NOISE), s) & (F.length(s) >= 3)
                  & ~s.startswith("/")
                  & ~((F.lower(F.substring(s, 1, 1)) == F.substring(s, 1, 1))
                      & (F.upper(F.substring(s, 1, 1)) != F.substring(s, 1, 1))))
    return F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(""))


_SCHOOLS = "struct<value:array<struct<organization:string,{}:string,year:string>>>"
STATE_SCHEMA = ("struct<keySkills:struct<value:array<struct<string:string>>>,"
                "primaryEducation:" + _SCHOOLS.format("faculty") + ",additionalEducation:" + _SCHOOLS.format("name") +
                ",attestationEducation:" + _SCHOOLS.format("name") + ",area:struct<value:struct<title:string>>>")


def json_state(blob, schema: str = STATE_SCHEMA) -> Column:
    """parsed page state → struct(skills, education lines, courses =
    additional then attestation lines, area title).  A line is organization,
    faculty (or course name) and (year), empty parts left out.  Missing parts
    give empty lists and a null area."""
    s = F.from_json(_c(blob), schema)

    def filled(c):
        return F.when(c != "", c)

    def line(e, second):
        y = filled(e["year"])
        return F.concat_ws(" ", filled(e["organization"]), filled(e[second]), F.concat(F.lit("("), y, F.lit(")")))

    def rows(field, second):
        return F.coalesce(F.transform(s[field]["value"], lambda e: line(e, second)), F.array().cast("array<string>"))

    skills = F.filter(F.transform(s["keySkills"]["value"], lambda e: e["string"]), lambda x: x != "")
    return F.struct(F.coalesce(skills, F.array().cast("array<string>")).alias("skills"),
                    rows("primaryEducation", "faculty").alias("education"),
                    F.concat(rows("additionalEducation", "name"), rows("attestationEducation", "name")).alias("courses"),
                    s["area"]["value"]["title"].alias("area"))


def dimension_lookup(df: DataFrame, col: str, dim: DataFrame, dim_name: str, dim_id: str,
                     out: str = "area_id") -> DataFrame:
    """name → id via a dimension table (Spark broadcasts it if its bytes
    allow); the join is left so unknown names keep a null id and can be
    reported."""
    return df.join(dim.select(F.col(dim_name).alias(col), F.col(dim_id).alias(out)), col, "left")


def explode_catalogue(df: DataFrame, group: str, items: str, out: str = "item") -> DataFrame:
    """(sector, [professions]) catalogue → one row per profession."""
    return df.select(group, F.explode(items).alias(out))

"""Scalar column functions.

Every function maps Columns to a Column built from Spark built-ins, so it
stays inside whole-stage codegen (higher-order array functions run as JVM
expressions too).  All lookups use ``try_*`` forms so the functions behave
the same with ANSI mode on (Spark 4 default) or off.

Java regexes mirror Python's ``re`` via ``(?U)`` (Unicode classes: ``\\s``
then matches U+00A0, trap X4).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (do not edit):
#   currency token -> rouble rate, in the reference's order
CURRENCY_RATES = [
    ("₽", 1.0), ("$", 80.85), ("€", 94.14), ("₴", 1.94), ("₸", 0.150),
    ("₼", 47.8), ("₾", 33.5), ("Br", 28.7), ("so'm", 0.0068),
]
#   gender recode (P15) and its default
GENDER_MAP = [("Мужчина", "Мужчина"), ("Male", "Мужчина"),
              ("Женщина", "Женщина"), ("Female", "Женщина")]
GENDER_DEFAULT = "Неизвестно"
#   category labels
EXPERIENCE_OPTIONS = ["Нет опыта", "От 1 года до 3 лет", "От 3 до 6 лет", "Более 6 лет"]
EMPLOYMENT_OPTIONS = ["Полная занятость", "Частичная занятость", "Проектная работа"]
SCHEDULE_OPTIONS = ["Полный день", "Удаленная работа", "Гибкий график", "Сменный график", "Вахтовый метод"]
#   sentinel for "no data"
NDT = "NDT"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs for v in kv])


def _int_group(text: Column, pattern: str) -> Column:
    """First match's group 1 as int, null when there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).try_cast("long")


# -- F1 / F2 salary ----------------------------------------------------------

def salary_to_rub(text, missing_rate: float | None = 1.0) -> Column:
    """digit-only tokens joined, times the rate of the first currency
    token.  No currency token → ``missing_rate`` (1.0 = service, X1); with
    ``missing_rate=None`` such rows give null (notebook variant, fill 0)."""
    t = _c(text)
    toks = F.split(t, r"(?U)\s+")
    digits = F.array_join(F.filter(toks, lambda x: x.rlike(r"^[0-9]+$")), "")
    rates = _map(CURRENCY_RATES)
    first_cur = F.try_element_at(F.filter(toks, lambda x: F.array_contains(F.map_keys(rates), x)), F.lit(1))
    rate = F.try_element_at(rates, first_cur)
    if missing_rate is not None:
        rate = F.coalesce(rate, F.lit(float(missing_rate)))
    num = F.when(digits != "", digits).try_cast("double")
    empty = t.isNull() | (t == "") | (t == NDT) | num.isNull()
    return F.when(empty, F.lit(0.0)).otherwise(num * rate)


def salary_clean(x, upper: float = 1e7) -> Column:
    """Non-numeric, negative or above ``upper`` → 0.0."""
    v = _c(x).try_cast("double")
    return F.when(v.isNull() | (v < 0) | (v > upper), F.lit(0.0)).otherwise(v)


# -- F6 / F7 / F8 experience periods ----------------------------------------

def experience_months(text) -> Column:
    """first ``N год`` and first ``N лет`` both add 12·N, plus first
    ``N месяц``; zero → null (X2, X3)."""
    t = _c(text)
    y1 = _int_group(t, r"(?U)(\d+)\s*год")
    y2 = _int_group(t, r"(?U)(\d+)\s*лет")
    m = _int_group(t, r"(?U)(\d+)\s*месяц")
    total = F.coalesce(y1, F.lit(0)) * 12 + F.coalesce(y2, F.lit(0)) * 12 + F.coalesce(m, F.lit(0))
    return F.when(total > 0, total)


def experience_months_single(text) -> Column:
    """one alternation (год|лет|года), case-insensitive, first match only;
    months added; 0.0 when nothing matches or text is null."""
    t = _c(text)
    y = _int_group(t, r"(?iU)(\d+)\s*(год|лет|года)")
    m = _int_group(t, r"(?iU)(\d+)\s*месяц")
    return (F.coalesce(y, F.lit(0)) * 12 + F.coalesce(m, F.lit(0))).cast("double")


def months_to_text(months) -> Column:
    """F8: 38 → '3 г. 2 мес.'; null/0 → '—'."""
    m = _c(months).cast("long")
    y, r = F.floor(m / 12), m % 12
    s = F.concat_ws(" ", F.when(y > 0, F.concat(y.cast("string"), F.lit(" г."))),
                    F.when(r > 0, F.concat(r.cast("string"), F.lit(" мес."))))
    return F.when(m.isNull() | (m == 0) | (s == ""), F.lit("—")).otherwise(s)


def age_from_birth_year(y, current_year: int = 2026, default: float = 30.0) -> Column:
    """null → 30; values < 100 are ages already; else current_year − year
    kept when 18..90, otherwise 30."""
    v = _c(y).try_cast("double")
    age = F.lit(current_year) - F.floor(v)
    return (F.when(v.isNull(), F.lit(default))
             .when(v < 100, v)
             .when((age >= 18) & (age <= 90), age.cast("double"))
             .otherwise(F.lit(default)))


# -- F10 / F11 cleaning and tokens -------------------------------------------

def clean_text(text) -> Column:
    """keep Cyrillic/Latin letters, digits and blanks; collapse blanks;
    lower; trim; null → ''."""
    t = F.regexp_replace(_c(text), r"(?U)[^а-яА-ЯёЁa-zA-Z0-9\s]", " ")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.coalesce(F.trim(F.lower(t)), F.lit(""))


def simple_tokens(text, stop_words: list[str]) -> Column:
    """clean, split on blanks, drop stop words and tokens of length ≤ 2."""
    from .tokens import remove_stop_words
    toks = F.filter(F.split(clean_text(text), " "), lambda x: F.length(x) > 2)
    return remove_stop_words(toks, stop_words or [])


def list_literal_to_array(s) -> Column:
    """"['a', 'b']" → [a, b]."""
    return F.split(F.regexp_replace(_c(s), r"[\[\]']", ""), ", ")


# -- pair features F12-F18 ----------------------------------------------------

def location_match(area, location) -> Column:
    """1 when equal, else 0 (null → 0)."""
    return F.coalesce((_c(area) == _c(location)).cast("int"), F.lit(0))


def location_match_contains(area, location, blank_matches: bool = False) -> Column:
    """cleaned equality or containment either way → 1.0.  A blank cleaned
    city is contained in anything; the reference scores it 1.0 (X8), kept
    with ``blank_matches=True``; default 0.0."""
    return contains_either(area, location, clean_text(area), clean_text(location), blank_matches)


def contains_either(area, location, clean_area, clean_location, blank_matches: bool = False) -> Column:
    """F13 on already cleaned texts (clean once per entity, compare per pair)."""
    a, b = _c(clean_area), _c(clean_location)
    hit = (a == b) | F.contains(a, b) | F.contains(b, a)
    if not blank_matches:
        hit = hit & (a != "") & (b != "")
    return F.when(_c(area).isNull() | _c(location).isNull(), F.lit(0.0)).otherwise(hit.cast("double"))


def skill_count(skills, description) -> Column:
    """skills (repeats counted) found as case-sensitive substrings of the
    description; empty skills are not hits (X5)."""
    d = _c(description)
    n = F.size(F.filter(_c(skills), lambda s: s.isNotNull() & (s != "") & F.contains(d, s)))
    return F.when(d.isNull() | _c(skills).isNull(), F.lit(0)).otherwise(n)


def clean_skills(skills_text) -> Column:
    """F16 entity side: skills text split on , ; newline, cleaned, length > 2."""
    raw = F.regexp_replace(_c(skills_text), r"[\[\]'\"]", "")
    return F.filter(F.transform(F.split(raw, r"[,;\n]"), lambda s: clean_text(s)), lambda s: F.length(s) > 2)


def count_contained(items, text) -> Column:
    """Number of ``items`` (repeats counted) that are substrings of ``text``.
    Both should be column references (``text`` is read inside a lambda)."""
    t = _c(text)
    return F.size(F.filter(_c(items), lambda s: F.contains(t, s)))


def skill_count_clean(description, skills_text) -> Column:
    """F16: skills text split on , ; newline, cleaned, length > 2, counted when
    contained in the cleaned description; double.  For pair tables prefer
    computing ``clean_text``/``clean_skills`` once per entity and
    ``count_contained`` per pair (see ``plans.matching``)."""
    d = clean_text(description)
    sk = clean_skills(skills_text)
    acc = F.aggregate(sk, F.struct(d.alias("d"), F.lit(0).alias("h")),
                      lambda a, s: F.struct(a["d"].alias("d"), (a["h"] + F.contains(a["d"], s).cast("int")).alias("h")))
    n = acc["h"].cast("double")
    return F.when(_c(description).isNull() | _c(skills_text).isNull(), F.lit(0.0)).otherwise(n)


def position_words(position) -> Column:
    """Distinct non-empty words of the union of splits by ' ', '-', '_' (the
    unsplit string stays in the set when a separator is absent, X7)."""
    p = _c(position)
    bow = F.concat(F.split(p, " "), F.split(p, "-"), F.split(p, "_"))
    return F.array_distinct(F.filter(bow, lambda w: w != ""))


def position_share(position, description) -> Column:
    """share of position words contained in the description; blank or
    null → 0.0 (X6)."""
    words = position_words(position)
    d = _c(description)
    hits = F.size(F.filter(words, lambda w: F.contains(d, w)))
    n = F.size(words)
    return F.when(_c(position).isNull() | d.isNull() | (n == 0), F.lit(0.0)).otherwise(hits / n)


def token_set(text, stop_words: list[str]) -> Column:
    """F18 vacancy side: distinct cleaned tokens (length > 2, no stop words)."""
    sw = F.array(*[F.lit(w) for w in sorted(set(stop_words or []))]) if stop_words else F.array().cast("array<string>")
    return F.array_except(F.filter(F.split(clean_text(text), " "), lambda x: F.length(x) > 2), sw)


def token_share(vac_tokens, pos_tokens) -> Column:
    """F18 pair side: share of position tokens (repeats kept) found in the
    vacancy token set; empty → 0.0.  Arguments are column references."""
    vt, pt = _c(vac_tokens), _c(pos_tokens)
    n = F.size(pt)
    hits = F.size(F.filter(pt, lambda t: F.array_contains(vt, t)))
    return F.when(vt.isNull() | pt.isNull() | (n <= 0), F.lit(0.0)).otherwise(hits / n)


def position_share_tokens(description, position, stop_words: list[str]) -> Column:
    """token-equality share; position tokens keep repeats."""
    vt = token_set(description, stop_words)
    pt = simple_tokens(position, stop_words)
    # aggregate's start value is evaluated once (a lambda would re-tokenize per element)
    acc = F.aggregate(pt, F.struct(vt.alias("s"), F.lit(0).alias("h"), F.lit(0).alias("n")),
                      lambda a, t: F.struct(a["s"].alias("s"),
                                            (a["h"] + F.array_contains(a["s"], t).cast("int")).alias("h"),
                                            (a["n"] + 1).alias("n")))
    hits, n = acc["h"], acc["n"]
    return F.when(_c(description).isNull() | _c(position).isNull() | (n == 0), F.lit(0.0)).otherwise(hits / n)


# -- recodes and rules (P15, P17) ---------------------------------------------

def recode_gender(g) -> Column:
    """Dictionary recode with default."""
    return F.coalesce(F.try_element_at(_map(GENDER_MAP), _c(g)), F.lit(GENDER_DEFAULT))


def normalize_experience(v) -> Column:
    """P17a experience: ordered substring rules on the lower-cased text."""
    t = F.trim(F.lower(F.coalesce(_c(v), F.lit(""))))
    c = F.contains
    return (F.when(c(t, F.lit("нет")) | c(t, F.lit("не треб")), F.lit(EXPERIENCE_OPTIONS[0]))
             .when(c(t, F.lit("1")) & (c(t, F.lit("3")) | c(t, F.lit("год"))), F.lit(EXPERIENCE_OPTIONS[1]))
             .when(c(t, F.lit("3")) & (c(t, F.lit("6")) | c(t, F.lit("лет"))), F.lit(EXPERIENCE_OPTIONS[2]))
             .when(c(t, F.lit("6")) | c(t, F.lit("более")) | c(t, F.lit("свыше")), F.lit(EXPERIENCE_OPTIONS[3]))
             .otherwise(F.lit(EXPERIENCE_OPTIONS[0])))


def normalize_employment(v) -> Column:
    t = F.lower(F.coalesce(_c(v), F.lit("")))
    c = F.contains
    return (F.when(c(t, F.lit("частич")), F.lit(EMPLOYMENT_OPTIONS[1]))
             .when(c(t, F.lit("проект")) | c(t, F.lit("разовое")), F.lit(EMPLOYMENT_OPTIONS[2]))
             .otherwise(F.lit(EMPLOYMENT_OPTIONS[0])))


def normalize_schedule(v) -> Column:
    t = F.lower(F.coalesce(_c(v), F.lit("")))
    c = F.contains
    return (F.when(c(t, F.lit("удал")), F.lit(SCHEDULE_OPTIONS[1]))
             .when(c(t, F.lit("гибк")), F.lit(SCHEDULE_OPTIONS[2]))
             .when(c(t, F.lit("сменн")), F.lit(SCHEDULE_OPTIONS[3]))
             .when(c(t, F.lit("вахт")), F.lit(SCHEDULE_OPTIONS[4]))
             .otherwise(F.lit(SCHEDULE_OPTIONS[0])))


def apply_rules(v, rules: list[tuple[str, str]], default: str) -> Column:
    """Rule tables as data — first (substring, label) hit wins on
    the lower-cased text."""
    t = F.lower(F.coalesce(_c(v), F.lit("")))
    out = None
    for needle, label in rules:
        cond = F.contains(t, F.lit(needle.lower()))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def score_class(score, high: float = 0.75, mid: float = 0.5) -> Column:
    """High / mid / low label from a score."""
    s = _c(score)
    return F.when(s >= high, "high").when(s >= mid, "mid").otherwise("low")


# -- page / id helpers F19-F21, F38-F45 ---------------------------------------

def strip_html(t) -> Column:
    """drop tags."""
    return F.regexp_replace(_c(t), r"<[^>]+>", "")


def hex_slice_id(h) -> Column:
    """characters 9..18 of a hex hash as a decimal id; shorter → as is."""
    s = _c(h)
    return F.when(F.length(s) >= 18, F.conv(F.substring(s, 9, 10), 16, 10)).otherwise(s)


def id_from_url(url, pattern: str = r"/vacancy/(\d+)") -> Column:
    """numeric id captured from a URL; '' → null."""
    v = F.regexp_extract(_c(url), pattern, 1)
    return F.when(v != "", v)


def labelled_field(text, label_pattern: str) -> Column:
    """text after a labelled pattern (group 1), trimmed, '' when absent."""
    return F.trim(F.regexp_extract(_c(text), "(?iU)" + label_pattern, 1))


def safe_int(v, on_error: str = "null") -> Column:
    """bigint or null (default, X12); ``on_error='zero'`` gives 0."""
    r = _c(v).try_cast("bigint")
    return F.coalesce(r, F.lit(0).cast("bigint")) if on_error == "zero" else r


def list_to_text(arr, sep: str = ", ") -> Column:
    """list → display text; null/empty → ''."""
    return F.coalesce(F.array_join(_c(arr), sep), F.lit(""))


def falsy_zero(c) -> Column:
    """null or NaN → 0.0."""
    x = _c(c).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def text_build(*cols, sep: str = ". ") -> Column:
    """join non-blank trimmed parts."""
    return F.concat_ws(sep, *[F.when(F.trim(_c(c)) != "", F.trim(_c(c))) for c in cols])


def pair_text(a, b, sep: str = " [SEP] ") -> Column:
    """F42."""
    return F.concat(F.coalesce(_c(a), F.lit("")), F.lit(sep), F.coalesce(_c(b), F.lit("")))


def slug(name) -> Column:
    """non-alphanumeric runs → '_', trimmed of '_'."""
    return F.regexp_replace(F.regexp_replace(_c(name), r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")


def truncate(t, n: int, ellipsis: str = "...") -> Column:
    """first n characters plus an ellipsis when longer."""
    s = _c(t)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(ellipsis))).otherwise(s)


def head_plus(arr, n: int = 7) -> Column:
    """first n items joined, plus '+k' for the rest."""
    a = _c(arr)
    extra = F.size(a) - n
    return F.concat_ws(", ", F.slice(a, 1, n), F.when(extra > 0, F.concat(F.lit("+"), extra.cast("string"))))


def title_compose(title, level, sep: str = " — ") -> Column:
    """F45."""
    return F.concat_ws(sep, F.when(_c(title) != "", _c(title)), F.when(_c(level) != "", _c(level)))


# -- vacancy salary ranges (F3, F4, F5) ---------------------------------------

def _currency(t: Column) -> Column:
    low = F.lower(t)
    return (F.when(F.contains(t, F.lit("₽")) | F.contains(low, F.lit("руб")), F.lit("RUR"))
             .when(F.contains(t, F.lit("$")) | F.contains(t, F.lit("USD")), F.lit("USD"))
             .when(F.contains(t, F.lit("€")) | F.contains(t, F.lit("EUR")), F.lit("EUR")))


def salary_range_a(text) -> Column:
    """struct(salary_from, salary_to, salary_currency) — numbers are digit
    runs with inner blanks removed; 'от'+'до' → both, 'от' → from, 'до' → to,
    else the first number is 'from'."""
    t = _c(text)
    low = F.lower(t)
    nums = F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\d[\d\s]*\d|\d"), 0),
                       lambda x: F.regexp_replace(x, r"(?U)\s", "").try_cast("double"))
    n = F.size(nums)
    n0, n1 = F.try_element_at(nums, F.lit(1)), F.try_element_at(nums, F.lit(2))
    has_ot, has_do = F.contains(low, F.lit("от")), F.contains(low, F.lit("до"))
    frm = (F.when(has_ot & has_do & (n >= 2), n0).when(has_ot & (n >= 1), n0)
            .when(has_do & (n >= 1), F.lit(None)).when(n >= 1, n0))
    to = F.when(has_ot & has_do & (n >= 2), n1).when(has_ot & (n >= 1), F.lit(None)).when(has_do & (n >= 1), n0)
    empty = t.isNull() | (t == "")
    return F.struct(F.when(~empty, frm).cast("double").alias("salary_from"),
                    F.when(~empty, to).cast("double").alias("salary_to"),
                    F.when(~empty, _currency(t)).alias("salary_currency"))


def salary_range_b(text) -> Column:
    """numbers of ≥ 4 digits after joining digit groups split by blanks;
    'до' without 'от' → to; 'от' → from (+ to); a dash → from–to; else from."""
    t = _c(text)
    low = F.lower(t)
    clean = F.regexp_replace(t, r"(?U)(\d)\s+(\d)", "$1$2")
    nums = F.transform(F.regexp_extract_all(clean, F.lit(r"\d{4,}"), 0), lambda x: x.try_cast("double"))
    n = F.size(nums)
    n0, n1 = F.try_element_at(nums, F.lit(1)), F.try_element_at(nums, F.lit(2))
    has_ot, has_do = F.contains(low, F.lit("от")), F.contains(low, F.lit("до"))
    dash = F.contains(t, F.lit("—")) | F.contains(t, F.lit("–")) | F.contains(t, F.lit("-"))
    frm = (F.when(has_do & ~has_ot & (n >= 1), F.lit(None)).when(has_ot & (n >= 1), n0)
            .when(dash & (n >= 1), n0).when(n >= 1, n0))
    to = (F.when(has_do & ~has_ot & (n >= 1), n0).when(has_ot & (n >= 2), n1).when(has_ot, F.lit(None))
           .when(dash & (n >= 2), n1))
    empty = t.isNull() | (t == "")
    return F.struct(F.when(~empty, frm).cast("double").alias("salary_from"),
                    F.when(~empty, to).cast("double").alias("salary_to"),
                    F.when(~empty, _currency(t)).alias("salary_currency"))


def salary_gross(text) -> Column:
    """True for 'до вычета'/'gross', False for 'на руки', else null."""
    low = F.lower(_c(text))
    return (F.when(F.contains(low, F.lit("до вычета")) | F.contains(low, F.lit("gross")), F.lit(True))
             .when(F.contains(low, F.lit("на руки")), F.lit(False)))


# -- Russian dates (F23, F24) --------------------------------------------------
# Fixed values that must equal the reference's: genitive month names, in order.
RU_MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа",
             "сентября", "октября", "ноября", "декабря"]
_MONTHS_ALT = "|".join(RU_MONTHS)


def _month_num(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for i, m in enumerate(RU_MONTHS) for x in (F.lit(m), F.lit(i + 1))]),
                            F.lower(name))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    s = F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string"))
    return F.try_to_timestamp(s, F.lit("yyyy-M-d"))


def published_date(text) -> Column:
    """'опубликована 1 мая 2026' → timestamp (null when absent/invalid)."""
    t = _c(text)
    pat = r"(?iU)опубликована\s*(\d{1,2})\s*(" + _MONTHS_ALT + r")\s*(\d{4})"
    d, m, y = (F.regexp_extract(t, pat, i) for i in (1, 2, 3))
    return F.when(t.rlike(pat), _ymd(y, _month_num(m), d))


def relative_date(text, as_of) -> Column:
    """'Сегодня в hh:mm' / 'Сегодня' / 'Вчера' / 'd месяца [yyyy]'
    relative to ``as_of`` (a timestamp column); a month after as_of's month
    without a year means last year."""
    t, now = _c(text), _c(as_of)
    today = r"(?U)[Сс]егодня(?:\s+в\s+(\d{1,2}:\d{2}))?"
    hm = F.regexp_extract(t, today, 1)
    at_time = F.try_to_timestamp(F.concat(F.date_format(now, "yyyy-MM-dd"), F.lit(" "), hm, F.lit(":00")),
                                 F.lit("yyyy-MM-dd H:mm:ss"))
    dm = r"(?iU)(\d{1,2})\s+(" + _MONTHS_ALT + r")(?:\s+(\d{4}))?"
    d, mname, y = (F.regexp_extract(t, dm, i) for i in (1, 2, 3))
    m = _month_num(mname)
    year = F.when(y != "", y.cast("int")).otherwise(
        F.year(now) - F.when(m > F.month(now), F.lit(1)).otherwise(F.lit(0)))
    return (F.when(t.rlike(today), F.when(hm != "", at_time).otherwise(now))
             .when(t.rlike(r"[Вв]чера"), now - F.expr("INTERVAL 1 DAY"))
             .when(t.rlike(dm), _ymd(year, m, d)))


def longest_block(html, lo: int | None = None, hi: int | None = None, blocks=("p", "div", "section")) -> Column:
    """text of the longest leaf block (a ``blocks`` element holding no
    other one).  Inner tags go, text nodes are stripped and joined; scripts,
    styles and comments are not text.  ``lo`` / ``hi`` keep only lengths
    strictly between them.  The first of the longest wins; null when none.

    The page is cut before every block tag: a leaf is a piece that opens a
    block and is followed by the piece that closes it, so one linear split
    replaces a nested pattern."""
    names, ws = "|".join(blocks), r"[ \t\r\n\f]"
    h = F.regexp_replace(_c(html), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>", "")
    pieces = F.split(h, r"(?i)(?=</?(?:" + names + r")\b)")
    opened, closed = r"(?i)^<((?:" + names + r")\b)?", r"(?i)^</((?:" + names + r")\b)?"
    # carries the piece before; a struct state keeps the page out of the lambda
    init = F.struct(F.lit("").alias("prev"), F.lit("").alias("best"))

    def step(a, x):
        tag = F.lower(F.regexp_extract(a["prev"], opened, 1))
        inner = F.regexp_replace(F.regexp_replace(a["prev"], r"^<[^>]*>", ""), ws + "*<[^>]*>" + ws + "*", "")
        t = F.regexp_replace(inner, "^" + ws + "+|" + ws + r"+\z", "")
        ok = (tag != "") & (tag == F.lower(F.regexp_extract(x, closed, 1)))
        if lo is not None:
            ok = ok & (F.length(t) > lo)
        if hi is not None:
            ok = ok & (F.length(t) < hi)
        return F.struct(x.alias("prev"),
                        F.when(ok, F.when(F.length(t) > F.length(a["best"]), t).otherwise(a["best"]))
                         .otherwise(a["best"]).alias("best"))

    best = F.aggregate(pieces, init, step)["best"]
    return F.when(best != "", best)


def explode_list_literal(s) -> Column:
    """U5: "[1, 2, 3]" → array<bigint> (never ``eval``)."""
    return F.transform(F.filter(list_literal_to_array(s), lambda x: F.trim(x) != ""),
                       lambda x: F.trim(x).try_cast("bigint"))


def schedule_variant_a(raw) -> Column:
    """Schedule mapping with the hybrid rule; unknown → the raw text,
    empty → ''."""
    r = _c(raw)
    t = F.lower(F.regexp_replace(r, r"(?U)\s+", " "))
    c = lambda s: F.contains(t, F.lit(s))
    return (F.when(r.isNull() | (r == ""), F.lit(""))
             .when(c("сменн"), F.lit("Сменный график"))
             .when(c("гибрид") | (c("удал") & (c("или") | c(", "))), F.lit("Гибкий график"))
             .when(c("удал"), F.lit("Удаленная работа"))
             .when(c("на месте") | c("офис"), F.lit("Полный день"))
             .otherwise(r))


def schedule_variant_b(raw) -> Column:
    """Schedule mapping with 2/2, 5/2 and remote rules; unknown → the
    trimmed raw text, empty → ''."""
    r = _c(raw)
    t = F.lower(F.regexp_replace(r, r"(?U)\s+", " "))
    c = lambda s: F.contains(t, F.lit(s))
    return (F.when(r.isNull() | (r == ""), F.lit(""))
             .when(c("сменн") | c("2/2") | c("3/3"), F.lit("Сменный график"))
             .when(c("гибк") | c("свободн"), F.lit("Гибкий график"))
             .when(c("удал") | c("дистанц") | c("remote"), F.lit("Удаленная работа"))
             .when(c("стандартн") | c("полн") | c("5/2"), F.lit("Полный день"))
             .when(c("вахт"), F.lit("Вахтовый метод"))
             .otherwise(F.trim(r)))

"""Scalar functions on inline edge rows (FIXTURES §A edge cases, X-traps)."""

from pyspark.sql import functions as F

from pairmill.functions import text as T
from pairmill.functions.tokens import default_stop_words, tokenize


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_salary_nbsp_currency_and_missing(spark):
    rows = [("150 000 ₽",), ("150 000",), ("",), ("NDT",), ("1 000 $",), (None,), ("-5 €",)]
    got = one(spark, T.salary_to_rub("t"), rows, "t string")
    assert got == [150000.0, 150000.0, 0.0, 0.0, 80850.0, 0.0, 0.0]
    nb = one(spark, F.coalesce(T.salary_to_rub("t", missing_rate=None), F.lit(0.0)), rows, "t string")
    assert nb[1] == 0.0 and nb[0] == 150000.0  # X1: notebook variant


def test_experience_months_variants(spark):
    rows = [("3 года 2 месяца",), ("12 лет",), ("нет",), (None,), ("2 года 3 лет",)]
    assert one(spark, T.experience_months("t"), rows, "t string") == [38, 144, None, None, 60]
    # Single alternation keeps only the first match
    assert one(spark, T.experience_months_single("t"), rows, "t string") == [38.0, 144.0, 0.0, 0.0, 24.0]
    assert one(spark, T.months_to_text(F.lit(38)), [(1,)], "x int") == ["3 г. 2 мес."]


def test_skills_and_position(spark):
    rows = [(["SQL", "Python", ""], "SQL, Python", "Data-Engineer", "Data pipelines"),
            ([], "x", "   ", "x"), (["SQL", "SQL"], "SQL", "", "SQL")]
    s = "sk array<string>, d string, p string, d2 string"
    assert one(spark, T.skill_count("sk", "d"), rows, s) == [2, 0, 2]  # X5 empty skill not a hit
    got = one(spark, T.position_share("p", "d2"), rows, s)
    assert abs(got[0] - 1 / 3) < 1e-12 and got[1] == 0.0 and got[2] == 0.0  # X6, X7
    words = one(spark, F.array_sort(T.position_words("p")), rows[:1], s)[0]
    assert words == ["Data", "Data-Engineer", "Engineer"]


def test_location_matching(spark):
    rows = [("Москва", "Москва"), ("Москва", "г. Москва"), ("", "Москва"), (None, "Москва")]
    s = "a string, b string"
    assert one(spark, T.location_match("a", "b"), rows, s) == [1, 0, 0, 0]
    assert one(spark, T.location_match_contains("a", "b"), rows, s) == [1.0, 1.0, 0.0, 0.0]
    assert one(spark, T.location_match_contains("a", "b", blank_matches=True), rows, s)[2] == 1.0  # X8


def test_category_rules_and_recode(spark):
    rows = [("Нет опыта",), ("От 1 года до 3 лет",), ("3-6 лет",), ("более 6 лет",), (None,)]
    got = one(spark, T.normalize_experience("t"), rows, "t string")
    assert got == ["Нет опыта", "От 1 года до 3 лет", "От 3 до 6 лет", "Более 6 лет", "Нет опыта"]
    assert one(spark, T.recode_gender("t"), [("Male",), ("x",)], "t string") == ["Мужчина", "Неизвестно"]


def test_tokenizer_accents_and_stop_words(spark):
    toks = one(spark, tokenize(F.col("t")), [("Éléphant ёлка й 42 _x ab",)], "t string")[0]
    assert toks == ["elephant", "елка", "ab"]  # accents stripped (й → и is then too short), '_x' dropped
    sw = default_stop_words()
    assert "the" in sw and "и" in sw and len(sw) > 300


def test_misc_helpers(spark):
    assert one(spark, T.slug(F.lit("  Data Analyst / ML ")), [(1,)], "x int") == ["Data_Analyst_ML"]
    assert one(spark, T.hex_slice_id(F.lit("0123456789abcdef0123")), [(1,)], "x int") == [str(int("89abcdef01", 16))]
    assert one(spark, T.safe_int(F.lit("user42")), [(1,)], "x int") == [None]  # X12
    assert one(spark, T.age_from_birth_year(F.lit(1990)), [(1,)], "x int") == [36.0]

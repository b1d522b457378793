"""Profile/vacancy page extractors on an inline résumé card."""

from pyspark.sql import functions as F

from pairmill.functions import parse as P

CARD = "\n".join([
    "Иван Петров", "Data Engineer", "Старший (Senior)", "Ищу работу", "от 250 000 ₽",
    "Возраст", "34 года", "Опыт работы", "7 лет 3 месяца", "ООО Ромашка", "Москва", "Ведущий инженер данных",
    "Март 2022 — Настоящее время", "Строил хранилище", "Писал пайплайны",
    "Навыки", "SQL", "Python", "Выберите навык", "Apache Spark", "Опыт работы",
    "Обо мне", "Люблю данные", "Образование", "Хабр Карьера", "МГУ им. Ломоносова", "2010",
])


def test_card_extractors(spark):
    df = spark.createDataFrame([(CARD,)], "t string").select("t", P.lines("t").alias("ls"))
    r = df.select(P.level("t"), P.status("t"), P.salary_phrase("t"), P.age_from_lines("ls"),
                  P.experience_line("ls"), P.skills_section("ls"), P.about_section("ls"),
                  P.last_experience("ls").alias("x"), P.education("ls")).first()
    assert r[0] == "Старший (Senior)" and r[1] == "Ищу работу" and r[2] == "от 250 000 ₽"
    assert r[3] == 34 and r[4] == "7 лет 3 месяца"
    assert r[5] == ["SQL", "Python", "Apache Spark"] and r[6] == "Люблю данные"
    x = r["x"]
    assert x["company"] == "7 лет 3 месяца"  # the first line after the heading, as in the reference
    assert r[8] == "МГУ им. Ломоносова"


def test_last_experience_state_machine(spark):
    ls = ["Опыт работы", "ООО Ромашка", "Москва", "Ведущий инженер", "Март 2022 — Настоящее время",
          "Строил хранилище", "Писал пайплайны", "Образование", "МГУ"]
    r = spark.createDataFrame([(ls,)], "ls array<string>").select(P.last_experience("ls").alias("x")).first()["x"]
    assert (r["company"], r["position"], r["period"]) == ("ООО Ромашка", "Ведущий инженер", "Март 2022 — Настоящее время")
    assert r["description"] == "Строил хранилище Писал пайплайны"


def test_links_titles_sections(spark):
    rows = [("/ivan_petrov",), ("/companies/x",), ("/vacancies",), ("/ab",), ("/für",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(P.is_profile_link("h")).collect()]
    assert got == [True, False, False, False, False]
    t = "Вакансия: работа в компании Ромашка, Москва (вакансия №1)"
    d = "Обязанности: писать код\nлюбить данные\nТребования: SQL"
    r = spark.createDataFrame([(t, d)], "t string, d string").select(
        P.employer_from_title("t"), P.section("d", ["Обязанности"]), P.first_known("t", ["Москва", "Казань"])).first()
    assert r[0] == "Ромашка" and r[1] == "писать код\nлюбить данные" and r[2] == "Москва"


def test_json_state(spark):
    """The state's real shape: every field holds its data under ``value``."""
    blob = ('{"keySkills": {"value": [{"string": "SQL"}, {"string": "Python"}, {"string": ""}]}, '
            '"primaryEducation": {"value": [{"organization": "МГУ", "faculty": "ВМК", "year": 2010}, {"organization": "МФТИ"}]}, '
            '"additionalEducation": {"value": [{"organization": "A", "name": "B"}]}, '
            '"attestationEducation": {"value": [{"name": "C", "year": 2020}]}, '
            '"area": {"value": {"title": "Москва"}}}')
    rows = [(blob,), ("{}",), ('{"keySkills": {"value": null}}',), (None,)]
    got = [r["s"] for r in spark.createDataFrame(rows, "b string").select(P.json_state("b").alias("s")).collect()]
    r = got[0]
    assert r["skills"] == ["SQL", "Python"] and r["education"] == ["МГУ ВМК (2010)", "МФТИ"]
    assert r["courses"] == ["A B", "C (2020)"] and r["area"] == "Москва"
    for r in got[1:]:
        assert (r["skills"], r["education"], r["courses"], r["area"]) == ([], [], [], None)


def test_sections_have_no_length_limit(spark):
    """Long sections come back whole, up to the next heading."""
    many = [f"строка описания {i}" for i in range(300)]
    card = ["Опыт работы", "ООО Ромашка", "Ведущий инженер", "Март 2022 — Настоящее время", *many, "Образование",
            *["Хабр Карьера"] * 9, "МГУ", "Навыки", *[f"Skill{i}" for i in range(200)], "Обо мне", *many]
    text = "Обязанности: " + "а" * 9000 + "\nТребования: SQL"
    df = spark.createDataFrame([(card, text)], "ls array<string>, t string")
    r = df.select(P.last_experience("ls").alias("x"), P.education("ls").alias("e"), P.skills_section("ls").alias("s"),
                  P.about_section("ls").alias("a"), P.section("t", ["Обязанности"]).alias("o")).first()
    assert r["x"]["description"] == " ".join(many) and r["a"] == " ".join(many)
    assert r["e"] == "МГУ" and len(r["s"]) == 200 and len(r["o"]) == 9000


def test_card_title_and_snippet(spark):
    ls = ["Иван Петров", "вчера", "Data", "Engineer", "•", "Senior", "Опыт работы", "3 компании", "7 лет", "Строил хранилище",
          "abc", "Написать"]
    r = spark.createDataFrame([(ls, "Иван Петров"), (ls, "Нет")], "ls array<string>, n string").select(
        P.title_from_lines("ls", "n"), P.description_snippet("ls")).collect()
    assert r[0][0] == "Data Engineer" and r[1][0] == "" and r[0][1] == "Строил хранилище"

"""Parsing functions on inline rows: salary ranges, dates, page blocks,
list literals, lemmas, factor similarity."""

import datetime as dt

from pyspark.sql import functions as F

from pairmill.functions import text as T
from pairmill.functions.tokens import lemmatize
from pairmill.operators.als import similar_items


def test_salary_ranges(spark):
    rows = [("от 90 000 до 120 000 ₽ на руки",), ("до 150 000 руб. до вычета налогов",), ("90 000 – 120 000 $",),
            ("от 5 000 €",), ("200 000",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    a = [tuple(r) for r in df.select(T.salary_range_a("t").alias("s")).select("s.*").collect()]
    assert a[0] == (90000.0, 120000.0, "RUR") and a[1] == (None, 150000.0, "RUR")
    assert a[2] == (90000.0, None, "USD") and a[3] == (5000.0, None, "EUR") and a[4] == (200000.0, None, None)
    b = [tuple(r) for r in df.select(T.salary_range_b("t").alias("s")).select("s.salary_from", "s.salary_to").collect()]
    assert b[2] == (90000.0, 120000.0) and b[1] == (None, 150000.0) and b[3] == (5000.0, None)
    g = [r[0] for r in df.select(T.salary_gross("t")).collect()]
    assert g[:3] == [False, True, None]


def test_dates(spark):
    as_of = dt.datetime(2026, 3, 10, 15, 0, 0)
    rows = [("Сегодня в 12:30",), ("Вчера",), ("23 апреля",), ("23 апреля 2025",), ("31 февраля",), ("опубликована1 мая 2026",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(T.relative_date("t", F.lit(as_of))).collect()]
    assert got[0] == dt.datetime(2026, 3, 10, 12, 30) and got[1] == dt.datetime(2026, 3, 9, 15, 0)
    assert got[2] == dt.datetime(2025, 4, 23)  # month after as_of's month → last year
    assert got[3] == dt.datetime(2025, 4, 23) and got[4] is None
    pub = [r[0] for r in df.select(T.published_date("t")).collect()]
    assert pub[5] == dt.datetime(2026, 5, 1) and pub[0] is None


def test_longest_block_and_lists(spark):
    html = ["<p>" + "a" * 150 + "</p><div><p class='x'>" + "b" * 300 + "</p></div><p>short</p>",
            "<div><p>aa</p><DIV id=1> b <b>c</b> d<br/></DIV></div><script>var x = '<p>" + "z" * 99 + "</p>'</script>",
            "<section>" + "s" * 50_000 + "</section><p><i>x</i></p>", "<span>none</span>", "", None]
    df = spark.createDataFrame([(i, h, "[1, 2, 3]") for i, h in enumerate(html)], "i int, h string, l string")
    r = df.orderBy("i").select(T.longest_block("h"), T.explode_list_literal("l"), T.longest_block("h", 100, 6000)).collect()
    assert [x[0] for x in r] == ["b" * 300, "bcd", "s" * 50_000, None, None, None]
    assert [x[2] for x in r] == ["b" * 300, None, None, None, None, None] and r[0][1] == [1, 2, 3]


def test_lemmatize_keeps_order(spark):
    docs = spark.createDataFrame([(1, ["работы", "данных", "sql"])], "id int, toks array<string>")
    lem = spark.createDataFrame([("работы", "работа"), ("данных", "данные")], "form string, lemma string")
    assert lemmatize(docs, "id", "toks", lem).first()["lemmas"] == ["работа", "данные", "sql"]
    assert lemmatize(docs, "id", "toks").first()["lemmas"] == ["работы", "данных", "sql"]


def test_similar_items_excludes_self(spark):
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])],
                              "id string, f array<double>")
    got = [r.id for r in similar_items(f, "id", "f", "a", 2).collect()]
    assert got == ["d", "b"]


def test_mean_padding_and_one_against_all(spark):
    from pairmill.operators.als import one_against_all
    from pairmill.operators.tfidf import scores_with_mean_padding
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    sc = spark.createDataFrame([("a", 0.2), ("b", 0.4)], "id string, s double")
    got = {r.id: r.similarity_score_tfidf for r in scores_with_mean_padding(rows, sc, "id", "s").collect()}
    assert abs(got["c"] - 0.3) < 1e-12 and got["a"] == 0.2
    uf = spark.createDataFrame([("v1", [1.0, 2.0])], "vacancy_id string, uf array<double>")
    itf = spark.createDataFrame([("r1", [1.0, 1.0]), ("r2", [0.0, 1.0])], "resume_id string, if_ array<double>")
    s = {r.resume_id: r.als_score for r in one_against_all(uf, itf, "vacancy_id", "resume_id", "v1").collect()}
    assert s == {"r1": 3.0, "r2": 2.0}
    z = one_against_all(uf, itf, "vacancy_id", "resume_id", "nope").collect()
    assert all(r.als_score == 0.0 for r in z)

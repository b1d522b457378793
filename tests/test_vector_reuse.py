"""Derived vectors: a second run encodes nothing, a changed text encodes one row, a lost run encodes none twice."""

import pytest
from pyspark.sql import functions as F

from pairmill.sources import vectors
from pairmill.sources.vectors import fill_vectors, fingerprint


def _rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)


def _encoder(spark):
    seen = spark.sparkContext.accumulator(0)

    def batches(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf.assign(embedding=[[float(len(t)), 1.0] for t in pdf["text"]])[["id", "embedding"]]

    return seen, lambda df: df.select("id", "text").mapInPandas(batches, "id string, embedding array<float>")


def _got(filled):
    return {r.id: list(r.embedding) for r in filled.vectors.collect()}


def test_encodes_what_is_lacking_only(spark, tmp_path):
    seen, enc = _encoder(spark)
    texts, folder = {i: "x" * (i + 1) for i in range(40)}, str(tmp_path / "v")
    want = lambda: {str(i): [float(len(t)), 1.0] for i, t in texts.items() if t and t.strip()}
    one = fill_vectors(_rows(spark, texts), folder, "m", enc, buckets=4)
    assert (one.encoded, one.reused, seen.value) == (40, False, 40) and _got(one) == want()
    two = fill_vectors(_rows(spark, dict(reversed(texts.items()))), folder, "m", enc)
    assert (two.encoded, two.reused, seen.value) == (0, True, 40) and _got(two) == want()
    texts[7] = "changed"
    three = fill_vectors(_rows(spark, texts), folder, "m", enc)
    assert (three.encoded, three.reused, seen.value) == (1, False, 41) and _got(three) == want()
    del texts[3]
    four = fill_vectors(_rows(spark, texts), folder, "m", enc)  # fewer ids: nothing to encode, no vector too many
    assert (four.encoded, seen.value) == (0, 41) and _got(four) == want()
    texts[3] = "x" * 4
    five = fill_vectors(_rows(spark, texts), folder, "m", enc)  # it came back unchanged
    assert (five.encoded, seen.value) == (0, 41) and _got(five) == want()
    other = fill_vectors(_rows(spark, texts), folder, "n", enc)
    assert (other.encoded, seen.value) == (40, 81) and _got(other) == want()


def test_lost_between_vectors_and_fingerprint(spark, tmp_path, monkeypatch):
    seen, enc = _encoder(spark)
    rows, folder = _rows(spark, {1: "a", 2: "bb"}), str(tmp_path / "v")
    real = vectors.upsert_keyed

    def stop_at_prints(new, path, *a, **k):
        if path.endswith("prints"):
            raise RuntimeError("lost")
        return real(new, path, *a, **k)

    monkeypatch.setattr(vectors, "upsert_keyed", stop_at_prints)
    with pytest.raises(RuntimeError):
        fill_vectors(rows, folder, "m", enc, buckets=2)
    monkeypatch.undo()
    again = fill_vectors(rows, folder, "m", enc)
    assert (again.encoded, again.reused, seen.value) == (0, False, 2)
    assert fill_vectors(rows, folder, "m", enc).reused


def test_nulls_blanks_repeats_and_empty(spark, tmp_path):
    seen, enc = _encoder(spark)
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (3, "  "), (None, "c")], "id long, text string")
    got = fill_vectors(rows, str(tmp_path / "v"), "m", enc, buckets=2)
    assert _got(got) == {"1": [1.0, 1.0]} and got.encoded == 1
    none = fill_vectors(rows.limit(0), str(tmp_path / "e"), "m", enc)
    assert none.encoded == 0 and none.vectors.collect() == []


def test_fingerprint(spark):
    f = lambda *r: fingerprint(spark.createDataFrame(list(r), "a long, b string").repartition(2), "a", "b")
    assert f((1, "x"), (2, "y")) == f((2, "y"), (1, "x"))
    distinct = [f((1, "x")), f((1, "x"), (1, "x")), f((1, None)), f((1, "")), f((None, "x")), f((1, "y"), (2, "x")), f((1, "x"), (2, "y")),
                f((1, "x"), (1, "x"), (1, "x"))]
    assert len(set(distinct)) == len(distinct)
    assert fingerprint(spark.range(0), "id") == "0:-:-:-:-"

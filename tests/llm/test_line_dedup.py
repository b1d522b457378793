import re
from collections import defaultdict

from pairmill.llm import line_dedup

STRIP = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, keep_first=False):
    at = defaultdict(list)
    for d, t, *_ in rows:
        for i, x in enumerate((t or "").split("\n")):
            if k := STRIP.sub("", x).translate(LOW):
                at[k].append(d)
    bad = {k for k, v in at.items() if len(set(v)) >= min_docs}
    return sorted(((d, "\n".join(x for x in (t or "").split("\n") if STRIP.sub("", x).translate(LOW) not in bad)) for d, t, *_ in rows),
                  key=lambda r: (r[0] is None, r))


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string, n_lines string, text_hash string")
    return line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, **kw))


def test_against_brute_force(spark):
    rows = [(i, f"own {i}\n  Shared\t\nÉté {i % 3}\n\n" + "rep\n" * 3 + "tail", "k", "n", "h") for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", None, None, None), (None, "shared\nx", None, None, None), (None, "SHARED \ny", None, None, None),
             (22, "été 0\nÉTÉ 0\nİstanbul", None, None, None), (3, rows[3][1], None, None, None), (3, "other\nshared", None, None, None)]
    long = "\n".join("Shared" if i % 70 == 0 or 200 <= i < 340 else f"line {i}" for i in range(9000))
    rows.append((30, long, None, None, None))
    got = _run(spark, rows, min_docs=4)
    out = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=lambda r: (r[0] is None, r)) == brute(rows, 4)
    assert got.columns == ["doc_id", "text", "keep", "text_hash", "n_lines", "n_dropped"] or set(got.columns) == {
        "doc_id", "text", "keep", "n_lines", "text_hash", "n_dropped"}
    by = {r["doc_id"]: r for r in out if r["doc_id"] in (20, 21, 30)}
    assert (by[20]["n_lines"], by[20]["n_dropped"], by[20]["text"]) == (1, 0, "")
    assert by[30]["n_lines"] == 9000 and by[30]["n_dropped"] == long.split("\n").count("Shared")


def test_keep_first_and_empty(spark):
    rows = [(i, "a\nsame\nsame", None, None, None) for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in _run(spark, rows, min_docs=2, keep_first=True).collect()}
    assert out == {0: "a\nsame", 1: "", 2: ""}
    assert _run(spark, [], min_docs=2).count() == 0

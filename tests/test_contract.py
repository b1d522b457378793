"""Driver contract: entry() runs; every oracle key is a registered query;
SQL-checked queries agree with DuckDB at sf0.001."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["vacancy_id", "rank", "resume_id"]


def test_oracle_keys_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 48


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    from tools.type_check import MAP
    stypes = {f.name: MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(rel.columns, drows)


HOLD_OUT = "SELECT CAST(sum(ceil(n * 0.2)) AS BIGINT) FROM (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality)"
#: what SQL can tell of a model query: its number of rows
ROWS = {
    "als_scores": "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"
                  " + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey))",
    "train_rank_lr": HOLD_OUT, "train_rank_gbt": HOLD_OUT, "train_rank_rf": HOLD_OUT,
    "score_batch": "SELECT count(*) FROM documents JOIN labels USING (doc_id)",
    "word2vec_sim": "SELECT count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "encode_missing": "SELECT count(*) FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "robustness_shift": "SELECT 3", "model_comparison": "SELECT 4", "feature_importance": "SELECT 3", "cv_search": "SELECT 4",
}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries(spark, duck, name):
    """The number of rows that SQL gives (at least one where it gives none),
    finite numbers, and probabilities from 0 to 1."""
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    if name in ROWS:
        assert len(rows) == duck.sql(ROWS[name]).fetchall()[0][0]
    else:
        assert rows
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double":
            values = [r[f.name] for r in rows if r[f.name] is not None]
            assert all(math.isfinite(v) for v in values), f.name
            if f.name == "probability":
                assert len(values) == len(rows) and all(0 <= v <= 1 for v in values)

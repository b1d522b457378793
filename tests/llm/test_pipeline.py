import re
from collections import defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from pairmill.llm import fm_index, toxicity
from pairmill.llm.common import BATCH_CONF, map_arrow

SF = "/root/testdata/sf0.01"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out[name] = (docs, done)
        docs = done
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontaminate", "mix_sources"]
    for name, (_, done) in list(steps.items())[:-1]:
        assert done.columns == COLS, name
        assert all(r["n_chars"] == len(r["text"]) for r in done.collect())
    assert set(COLS) < set(steps["mix_sources"][1].columns)


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    score = dict(zip((r["doc_id"] for r in rows), model.score([r["text"] for r in rows])))
    stays = {r["doc_id"] for r in rows if score[r["doc_id"]] < model.thresholds.get(r["lang"], model.threshold)}
    assert set(_texts(after)) == stays and 0 < len(stays) < len(rows)


def test_line_dedup(steps):
    before, after = map(_texts, steps["line_dedup"])
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    where = defaultdict(set)
    for i, t in before.items():
        for x in t.split("\n"):
            where[key(x)].add(i)
    first, want = set(), {}
    for i in sorted(before):
        lines = before[i].split("\n")
        kept = []
        for x in lines:
            k = key(x)
            if not k or len(where[k]) < 10 or k not in first:
                kept.append(x)
                if k and len(where[k]) >= 10:
                    first.add(k)
        if len(kept) == len(lines) or "".join(kept).strip(" \t\n\x0b\x0c\r"):
            want[i] = "\n".join(kept)
    assert after == want


def test_near_copies(steps):
    from .test_jaccard_join import brute
    before, after = map(_texts, steps["jaccard_join"])
    found, _ = brute(sorted(before.items()))
    assert after == {i: before[i] for i, _, c in found if i == c}


def test_decontamination(spark, steps):
    before, after = map(_texts, steps["decontaminate"])
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i: i + 10]) for _, t in items for w in [fm_index.words_of(t.encode())] for i in range(max(1, len(w) - 9))}
    n_hit = 0
    for i, t in before.items():
        w = fm_index.words_of(t.encode())
        hit = {p for n in {len(g) for g in grams} for a in range(len(w) - n + 1) if tuple(w[a: a + n]) in grams for p in range(a, a + n)}
        if not hit:
            assert after[i] == t
        elif len(hit) == len(w):
            assert i not in after
        else:
            n_hit += 1
            assert fm_index.words_of(after[i].encode()) == [x for p, x in enumerate(w) if p not in hit]
    assert n_hit > 0


def test_mix_keeps_all(steps):
    before, after = steps["mix_sources"]
    rows = after.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(_texts(before)) and all(r["copies"] >= 1 for r in rows)


def test_run_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows and extra columns pass through all stages; so does an empty table."""
    path = str(tmp_path)
    rows = [(1, "a b c d e f", "en", "s", 11, "x"), (1, "a b c d e f", "en", "s", 11, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"),
            (None, "no id here", "en", "s", 10, "x"), (4, "word " * 30_000, "en", "t", 150_000, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, weight string"
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "c d e"), (2, None)], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{path}/{name}.parquet")
        df.write.parquet(f"{path}/none/{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    got = cp.run(spark, path).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    assert {r["text"] for r in got if r["doc_id"] == 1} == {"a b  f"}
    spark.createDataFrame([], schema).write.parquet(f"{path}/none/documents.parquet")
    assert cp.run(spark, f"{path}/none").count() == 0


def test_extra_columns_of_any_name(spark, tmp_path):
    """Columns called like those that the operators make pass through every filtering stage unchanged."""
    names = ["items", "spans", "n_words", "n_lines", "n_dropped", "score", "rejected", "component_id", "stays", "words", "key", "h", "_carried_0", "copies"]
    rows = [(i, f"text number {i} a b c d e f g", "en", "s", 0, *[f"{n}-{i}" for n in names]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLS + names, name
    got = docs.collect()
    assert len(got) == 5 and all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in names)
    assert all("c d e" not in r["text"] for r in got)


def test_batches_are_short(spark):
    """A stage gets all rows in batches of a fifth of what the operators take, and the session's bound is back after a run."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n_chars": [b.num_rows]})
    before = spark.conf.get(BATCH_CONF)
    try:
        spark.conf.set(BATCH_CONF, "10000")
        docs = spark.range(3050, numPartitions=1).toDF("n_chars")
        got = [r[0] for r in cp._carries(lambda s, d, _: map_arrow(d, sizes, d.schema))(spark, docs, "").collect()]
        assert sum(got) == 3050 and max(got) == 200
        spark.conf.set(BATCH_CONF, "10000")
        assert cp.run(spark, "/root/testdata/sf0.001").count() > 0 and spark.conf.get(BATCH_CONF) == "10000"
    finally:
        spark.conf.set(BATCH_CONF, before)


def test_decontaminate_uses_one_worker_a_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = cp.decontaminate(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1

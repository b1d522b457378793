"""Corpus pipeline: the stages that turn ``documents`` into a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``n_chars`` follows the text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import fm_index, jaccard_join, line_dedup, mixing, toxicity
from pairmill.llm.common import BATCH_CONF, bound_batches, staged, table

#: The columns that operators know; any other is only carried along.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of an Arrow batch here: whole rows travel, and an executor that runs all stages keeps the heap of its largest batches
BATCH_ROWS = 200


def _carries(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage in short batches whose operator may use any column name: other columns of ``docs`` bear numbers until it is done."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        bound_batches(spark, BATCH_ROWS)
        return stage(spark, docs.toDF(*[c if c in KNOWN else f"_carried_{i}" for i, c in enumerate(names)]), sf_dir).toDF(*names)
    return run


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with the length of the text that is left."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(columns)


@_carries
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go; the model learns from the labelled ones.

    A score equal to the threshold rejects.  Null and empty texts are scored as
    texts without words, long ones whole; a language that is null or has no
    threshold of its own has the common one.  Repeated rows are scored alike.
    Rows with a null id have no label.  An empty table stays empty.  Other
    columns are kept, whatever their names.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not rejected").select(docs.columns)


@_carries
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line in 10 or more documents stays in the first of them only.

    A document that loses lines and has no other text left goes; one that had
    no text to begin with stays.
    """
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, keep_first=True)
    done = line_dedup.apply_bitmaps(docs, bitmaps)
    return _counted(done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


@_carries
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays.

    An id that comes with several texts goes only if all of them go.  Of a null
    id's texts, those stay that link with no document that has an id.
    """
    found = jaccard_join.join_sets(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = staged(found.groupBy("doc_id").agg(F.max(stays).alias("stays")).where("not stays").select(F.col("doc_id").alias("_gone")), "pipeline-near")
    # read back from Parquet, so Spark chooses the join by its bytes
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


@_carries
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages are cut out; a document of which nothing else is left goes.

    Null and empty texts have no words and stay as they are, long ones are
    searched whole.  Each of repeated rows is searched alike.  Items that are
    null or without words name nothing; an empty benchmark changes no text, an
    empty table stays empty.  Other columns are kept, whatever their names.
    """
    # written in between: else each task keeps a worker for the search and one for the cut, and executors keep the idle ones
    found = staged(fm_index.find_spans(docs, table(spark, sf_dir, "benchmark")), "pipeline-spans")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return _counted(fm_index.remove_spans(found.where((F.size("spans") == 0) | (hit < F.col("n_words")))), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of copies that it has in the mix: at least one, and four passes of a source at most.

    Null and empty texts count as documents without words; rows with a null
    source are a source of their own.  Repeated rows are rows of their own.  An
    empty table stays empty.
    """
    return mixing.mix(docs, max_repeat=4.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_near),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rows = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_CONF)
    try:
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(BATCH_CONF, rows)
    return STAGES[-1][1](spark, docs, sf_dir)

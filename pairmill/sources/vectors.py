"""Derived vectors that are kept and used again.

A folder holds, as keyed tables, the vectors by (id, model) with the digest of
the text each was made from, and one fingerprint a model of the (id, text) rows
it was last filled for.  Equal fingerprint: the vectors are read and nothing is
looked for.  Otherwise rows whose id is new or whose text differs are encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .keyed import BUCKETS, lookup, read_keyed, upsert_keyed

KEYS = ["id", "model_name"]


@dataclass(frozen=True)
class Filled:
    """``vectors`` (id, embedding) of the rows asked for; ``encoded``: how many of them were made now."""

    vectors: DataFrame
    encoded: int
    reused: bool


def fingerprint(rows: DataFrame, *cols: str) -> str:
    """One string for the rows' multiset, whatever their order and partitions.

    Count, sum and xor of two 64-bit hashes a row.  Null differs from empty,
    and a repeated row from a single one.
    """
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    a, b = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    wide = lambda h: F.sum(h.cast("decimal(20,0)"))
    r = rows.agg(F.count(F.lit(1)), wide(a), wide(b), F.bit_xor(a), F.bit_xor(b)).first()
    return ":".join("-" if v is None else str(v) for v in r)


def fill_vectors(rows: DataFrame, folder: str, model: str, encode, id_col: str = "id", text_col: str = "text",
                 buckets: int = BUCKETS) -> Filled:
    """Vectors of all ``rows`` under ``model``, encoding only what ``folder`` lacks.

    ``encode`` turns a frame (id string, text) into (id, embedding); it gets
    rows whose text is new for their id.  Rows with a null id or a null or blank
    text have no vector; of several texts for one id the smallest counts.
    Vectors of ids that are not asked for stay for a later call.  Vectors are
    committed before the fingerprint, so a call that is lost between encodes
    nothing twice.  The folder's number of buckets is fixed by its first call.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    x = (rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
             .filter(F.col("id").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
             .groupBy("id").agg(F.min("text").alias("text")))
    want = x.select("id", F.sha2("text", 256).alias("digest"))
    # the digests stand for the texts here, so that the texts are read once more only if something is lacking
    want = checkpoint(want)
    print_now = fingerprint(want, "id", "digest")
    name = spark.createDataFrame([(model,)], "model_name string")
    kept = lookup(spark, f"{folder}/prints", name)
    same = kept is not None and (row := kept.first()) is not None and row["print"] == print_now
    encoded = 0
    if not same:
        held = read_keyed(spark, f"{folder}/vectors")
        todo = want
        if held is not None:
            mine = held.filter(F.col("model_name") == model).select("id", "digest")
            todo = want.join(mine, ["id", "digest"], "left_anti")
        todo = checkpoint(todo)
        encoded = todo.count()
        if encoded:
            texts = x.join(todo.select("id"), "id", "left_semi")
            new = encode(texts).select("id", "embedding").join(todo, "id").withColumn("model_name", F.lit(model))
            upsert_keyed(new, f"{folder}/vectors", KEYS, buckets=buckets)
        upsert_keyed(name.withColumn("print", F.lit(print_now)), f"{folder}/prints", ["model_name"], buckets=1)
    held = read_keyed(spark, f"{folder}/vectors")
    if held is None:  # no row ever had a text
        return Filled(spark.createDataFrame([], "id string, embedding array<float>"), 0, same)
    mine = held.filter(F.col("model_name") == model)
    return Filled(mine.join(want, ["id", "digest"], "left_semi").select("id", "embedding"), encoded, same)

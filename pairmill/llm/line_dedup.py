"""Line dedup: lines found in many documents, as per-document keep bitmaps.

Lines are hashed (128 bits), range-partitioned by hash and document with a
secondary sort by position.  A pass over each sorted run marks the first line
of a key in a document; the marks add up to the key's number of documents.
A key that is in very many documents spans several range partitions, as the
document is part of the range key.  The result is one bitmap for each document
that loses lines, never text.

A bitmap holds 64 lines a word (bit i of word w: line 64 w + i, set: keep) and
leaves out the words that keep all their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, free_names, staged, text_of

ALL_KEPT = -1  # 64 set bits


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """Array of comparison keys: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(lines_of(text), lambda x: F.btrim(ascii_lower(x), F.lit(WHITE)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Bitmaps of the documents that lose lines: ``doc_id``, ``text_hash``, ``keep``.

    A key (at least ``min_chars`` code points) found in at least ``min_docs``
    documents loses all its lines; with ``keep_first`` its first line, by
    document and position, stays.  ``keep`` is an array of (word, bits) for the
    64-line words that are not kept whole, by word.  ``text_hash`` tells apart
    the texts of a repeated id; documents are counted by id.

    Null or empty text is one empty line, whose key is too short to count when
    ``min_chars`` is 1 or more.  A null id counts as one document.  Repeated
    rows count once.  An empty table gives no rows.
    """
    text = text_of(docs, text_col)
    lines = (docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                         F.posexplode(line_keys(text)).alias("pos", "key"))
             .where(F.length("key") >= min_chars)
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                     "doc_id", "text_hash", "pos"))
    order = ["h1", "h2", "doc_id", "text_hash", "pos"]
    runs = staged(lines.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions(*order)
                  .withColumn("run", F.spark_partition_id()), "line-runs")
    before = Window.partitionBy("run").orderBy(*order)
    same = [F.lag(c).over(before).eqNullSafe(F.col(c)) for c in ("h1", "h2", "doc_id")]
    # the first row of a run has no row before it; its doc_id may be null as well
    first = ~(same[0] & same[1] & same[2]) | (F.row_number().over(before) == 1)
    frequent = (runs.withColumn("first", first).where("first")
                .groupBy("h1", "h2")
                .agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("kept"))
                .where(F.col("n_docs") >= min_docs))
    hits = runs.join(staged(frequent, "line-frequent"), ["h1", "h2"])
    if keep_first:
        hits = hits.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("kept")))
    one = F.expr("shiftleft(1L, pos % 64)")
    return (hits.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word"))
            .agg(F.bitwise_not(F.bit_or(one)).alias("bits"))
            .groupBy("doc_id", "text_hash")
            .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep")))


def dense_words(keep: Column) -> Column:
    """All words up to the last listed one; a null bitmap gives an empty array."""
    gaps = F.transform(keep, lambda x, i: F.struct(
        (x["word"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"]) - 1).alias("gap"),
        x["bits"].alias("bits")))
    filled = F.flatten(F.transform(gaps, lambda x: F.concat(
        F.array_repeat(F.lit(ALL_KEPT).cast("bigint"), x["gap"]), F.array(x["bits"]))))
    return F.coalesce(filled, F.array().cast("array<bigint>"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, plus ``n_lines`` and ``n_dropped``.

    Columns of ``docs`` stay as they are but for the text, which is empty
    instead of null; a column of ``docs`` called n_lines or n_dropped is
    replaced.  Row count and repeated rows stay.
    """
    h, m, w, a = free_names(docs.columns, "text_hash", "keep", "keep_words", "lines")
    bm = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("keep").alias(m))
    text = text_of(docs, text_col)
    left = docs.withColumn(text_col, text)
    left = left.withColumn(h, F.xxhash64(text_col))
    out = left.join(bm, left[id_col].eqNullSafe(bm["_id"]) & (left[h] == bm["_hash"]), "left")
    out = out.withColumn(w, dense_words(F.col(m))).withColumn(a, lines_of(F.col(text_col)))

    def stays(_line: Column, i: Column) -> Column:
        word = F.get(F.col(w), F.floor(i / 64).cast("int"))
        return word.isNull() | (F.getbit(word, i % 64) == 1)

    kept = F.filter(F.col(a), stays)
    out = out.withColumn("n_lines", F.size(a).cast("bigint"))
    out = out.withColumn(text_col, F.when(F.col(m).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    dropped = F.expr(f"aggregate(`{m}`, 0L, (s, x) -> s + 64 - bit_count(x.bits))")
    out = out.withColumn("n_dropped", F.coalesce(dropped, F.lit(0)).cast("bigint"))
    return out.drop(h, m, w, a, "_id", "_hash")

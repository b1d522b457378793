"""TF-IDF in long form.

Vectors are rows ``(id, term, w)`` rather than dense/sparse vector cells:
cosines become an equi-join on ``term`` plus a ``groupBy`` sum, which stays
in whole-stage codegen and partitions by term.  The vocabulary holds every
term unless ``max_features`` caps it; it is joined on the term, and Spark picks
the join by the bytes it finds (a frequent term's rows are split by AQE).

Fit rules follow the reference's vectorizer: tokens from T1 minus T2 stop
words, uni+bigrams, document frequency in [min_df, max_df · n_docs], the
``max_features`` most frequent terms if given (ties: term ascending), smooth IDF
``ln((1 + n) / (1 + df)) + 1`` (Spark ML's ``IDF`` lacks the +1), raw
counts × idf, L2 normalised per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import stop_words_remover, tokenize, uni_bi_grams
from ..session import checkpoint, collect_garbage, scalar


def grams(df: DataFrame, id_col: str, text: str, ngram_max: int = 2, stop_words=None, tokenizer=tokenize) -> DataFrame:
    """(id, term) rows, one per occurrence.  ``tokenizer`` turns a text column
    into an array of words without spaces (UDF2)."""
    # tokens are materialised as a column first: a lambda that referenced the
    # token expression would re-run the tokenizer once per array element
    raw = df.select(id_col, tokenizer(F.col(text)).alias("__raw"))
    toks = stop_words_remover("__raw", "__tok", stop_words).transform(raw)
    g = uni_bi_grams(F.col("__tok")) if ngram_max >= 2 else F.col("__tok")
    return toks.select(id_col, F.explode(g).alias("term"))


def gram_counts(df: DataFrame, id_col: str, text: str, ngram_max: int = 2, stop_words=None, tokenizer=tokenize,
                lemmas: pa.Table | None = None) -> DataFrame:
    """(id, term, c): how often each term stands in each text.  ``id_col`` is
    distinct, so a text's terms are sorted and counted in its own row: no shuffle.
    Words are translated by ``lemmas`` (form, lemma) first, if given."""
    raw = df.select(id_col, tokenizer(F.col(text)).alias("__raw"))
    toks = stop_words_remover("__raw", "__tok", stop_words).transform(raw).filter(F.size("__tok") > 0)
    if lemmas is not None:
        toks = translate_words(toks.select(id_col, "__tok"), lemmas)
    g = uni_bi_grams(F.col("__tok")) if ngram_max >= 2 else F.col("__tok")
    s = toks.select(id_col, F.array_sort(g).alias("__s")).withColumn("__n", F.size("__s"))
    at = lambda i: F.get("__s", i)
    starts = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    s = s.withColumn("__a", starts).withColumn("__z", F.concat(F.slice("__a", 2, F.size("__a")), F.array("__n")))
    runs = s.select(id_col, "__s", F.explode(F.arrays_zip("__a", "__z")).alias("__x"))
    return runs.select(id_col, F.get("__s", F.col("__x.__a")).alias("term"), (F.col("__x.__z") - F.col("__x.__a")).cast("long").alias("c"))


#: forms of a lemma table that every task gets whole (some 25 bytes each)
LEMMA_FORMS = 2_000_000


def single_lemmas(lemmas: DataFrame) -> DataFrame:
    """(form, lemma): the smallest lemma of each form that changes."""
    return (lemmas.filter(F.col("form").isNotNull() & F.col("lemma").isNotNull() & (F.col("form") != F.col("lemma")))
                  .groupBy("form").agg(F.min("lemma").alias("lemma")))


def translate_words(rows: DataFrame, lemmas: pa.Table) -> DataFrame:
    """``rows`` (id, words) with the lemma of each word that has one; each batch
    looks its distinct words up in the table, which tasks get as one broadcast."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, lemmas.schema) as w:
        w.write_table(lemmas)
    shared = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        form, lemma = (pa.chunked_array(table.column(c), pa.string()).combine_chunks() for c in ("form", "lemma"))
        for b in batches:
            ids, words = b.columns
            found = words.flatten().cast(pa.string()).dictionary_encode()
            to = pc.coalesce(lemma.take(pc.index_in(found.dictionary, value_set=form)), found.dictionary)
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)).cast(pa.int32())
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, to.take(found.indices))], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def lemma_counts(counts: DataFrame, lemmas: DataFrame, key: str = "__h") -> DataFrame:
    """Counts of terms → counts of their lemmas (forms without one stay),
    for lemma tables of any size.

    Each word of a uni- or bigram stands for its lemma, so the sequence of
    lemmas has the grams that translating the grams of forms gives.  That needs
    one translation a distinct term of the corpus, not one a token; only counts
    of terms that change, or that others change to, are summed again.
    ``lemmas`` (form, lemma) may repeat a form (its smallest lemma counts) and
    hold nulls (left out).
    """
    lem = single_lemmas(lemmas)
    words = F.split("term", " ")
    terms = counts.select("term").distinct().select("term", words[0].alias("__a"), F.get(words, 1).alias("__b"))
    of = lambda c: lem.select(F.col("form").alias(c), F.col("lemma").alias(c + "l"))
    changed = checkpoint(terms.join(of("__a"), "__a", "left").join(of("__b"), "__b", "left")
                         .filter(F.col("__al").isNotNull() | F.col("__bl").isNotNull())
                         .select("term", F.concat_ws(" ", F.coalesce("__al", "__a"), F.coalesce("__bl", "__b")).alias("__lemma")))
    targets = changed.select(F.col("__lemma").alias("term")).distinct().join(changed, "term", "left_anti")
    table = changed.unionByName(targets.select("term", F.col("term").alias("__lemma")))
    tagged = counts.join(table, "term", "left")
    moved = tagged.filter(F.col("__lemma").isNotNull()).groupBy(key, "__lemma").agg(F.sum("c").alias("c"))
    return (tagged.filter(F.col("__lemma").isNull()).select(key, "term", "c")
            .unionByName(moved.select(key, F.col("__lemma").alias("term"), "c")))


def text_counts(df: DataFrame, text: str, ngram_max: int = 2, stop_words=None, tokenizer=tokenize,
                lemmas: DataFrame | None = None, keep: bool = True) -> tuple[DataFrame, int]:
    """Term counts per *distinct* text, keyed by the text's md5 (``__h``),
    and the number of distinct texts.  Tokenising once per distinct text is
    the reference's dedupe-encode-map step (T8).  ``keep`` checkpoints the
    counts for callers that read them several times; they are several times
    the texts, so where disk counts they are made again.  With ``lemmas``
    (form, lemma), what is left after the stop words counts as its lemma (T3):
    a table of at most ``LEMMA_FORMS`` forms goes to the tasks, which translate
    the words of a text in its row; a larger one is joined with the counts."""
    rows = df.select(F.col(text).alias("__text")).filter(F.col("__text").isNotNull()).withColumn("__h", F.md5("__text"))
    n = rows.select("__h").distinct().count()
    table = None
    if lemmas is not None:
        lemmas = checkpoint(single_lemmas(lemmas))
        table = lemmas.toArrow() if lemmas.count() <= LEMMA_FORMS else None
    # texts are shuffled once, and counted where their copies meet
    counts = gram_counts(rows.distinct(), "__h", "__text", ngram_max, stop_words, tokenizer, table)
    if lemmas is not None and table is None:
        counts = lemma_counts(counts, lemmas)
    return (checkpoint(counts) if keep else counts), int(n)


def fit_counts(counts: DataFrame, n: int, min_df: int = 2, max_df: float = 0.8,
               max_features: int | None = None) -> DataFrame:
    """Vocabulary (term, df, tf, idf) from per-text counts."""
    dfs = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("tf"))
    kept = dfs.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n)))
    if max_features:
        kept = kept.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return kept.withColumn("idf", F.log((F.lit(1.0) + n) / (F.col("df") + 1)) + 1)


def weigh_counts(counts: DataFrame, vocab: DataFrame, key: str = "__h", only: DataFrame | None = None) -> DataFrame:
    """L2-normalised TF-IDF (key, term, w); of the terms of ``only`` (term), if
    given, with norms over all terms."""
    x = counts.join(vocab.select("term", "idf"), "term").withColumn("x", F.col("c") * F.col("idf"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("__norm"))
    if only is not None:
        x = x.join(only.select("term").distinct(), "term", "left_semi")
    return x.join(norm, key).select(key, "term", (F.col("x") / F.col("__norm")).alias("w"))


def map_to_rows(df: DataFrame, id_col: str, text: str, text_weights: DataFrame) -> DataFrame:
    """Per-text weights → per-row weights (id, term, w) by the text hash."""
    rows = df.select(id_col, F.md5(F.col(text)).alias("__h")).filter(F.col("__h").isNotNull())
    return rows.join(text_weights, "__h").select(id_col, "term", "w")


def fit(corpus: DataFrame, text: str, min_df: int = 2, max_df: float = 0.8, max_features: int | None = None,
        ngram_max: int = 2, stop_words=None, tokenizer=tokenize, lemmas: DataFrame | None = None) -> DataFrame:
    """Vocabulary (term, df, tf, idf) fitted on the *distinct* texts of
    ``corpus`` (the reference's service/retrain corpus rule, X9)."""
    counts, n = text_counts(corpus, text, ngram_max, stop_words, tokenizer, lemmas, keep=False)
    return fit_counts(counts, n, min_df, max_df, max_features)


def transform(df: DataFrame, id_col: str, text: str, vocab: DataFrame, ngram_max: int = 2,
              stop_words=None, tokenizer=tokenize, lemmas: DataFrame | None = None) -> DataFrame:
    """L2-normalised TF-IDF weights (id, term, w) of every row of ``df``
    (each distinct text is tokenised once)."""
    counts, _ = text_counts(df, text, ngram_max, stop_words, tokenizer, lemmas)
    return map_to_rows(df, id_col, text, weigh_counts(counts, vocab))


def fit_transform(df: DataFrame, id_col: str, text: str, min_df: int = 2, max_df: float = 0.8,
                  max_features: int | None = None, ngram_max: int = 2, stop_words=None, tokenizer=tokenize,
                  lemmas: DataFrame | None = None, only: DataFrame | None = None):
    """Fit on the distinct texts of ``df`` and weigh its rows.  Returns (vocab,
    (id, term, w)); with ``only`` (term) the weights of these terms alone,
    without keeping all counts on disk: the vocabulary, a part of them, is kept,
    and the fit's shuffle files are let go of before the texts are weighed."""
    counts, n = text_counts(df, text, ngram_max, stop_words, tokenizer, lemmas, keep=only is None)
    vocab = fit_counts(counts, n, min_df, max_df, max_features)
    if only is not None:
        vocab = checkpoint(vocab)
        collect_garbage(df.sparkSession)
    return vocab, map_to_rows(df, id_col, text, weigh_counts(counts, vocab, only=only))


def pair_cosine(pairs: DataFrame, a_vecs: DataFrame, b_vecs: DataFrame, a_id: str, b_id: str,
                out: str = "cosine") -> DataFrame:
    """Cosine of aligned pairs from long-form unit vectors; no shared
    term (or a missing vector) → 0.0."""
    a = a_vecs.select(F.col(a_id).alias("__a"), "term", F.col("w").alias("__wa"))
    b = b_vecs.select(F.col(b_id).alias("__b"), "term", F.col("w").alias("__wb"))
    p = pairs.select(F.col(a_id).alias("__a"), F.col(b_id).alias("__b")).distinct()
    dots = (p.join(a, "__a").join(b, ["__b", "term"])
             .groupBy("__a", "__b").agg(F.sum(F.col("__wa") * F.col("__wb")).alias("__dot")))
    return (pairs.join(dots.withColumnRenamed("__a", a_id).withColumnRenamed("__b", b_id), [a_id, b_id], "left")
                 .withColumn(out, F.coalesce("__dot", F.lit(0.0))).drop("__dot"))


def bow_vocab(counts: DataFrame, min_count: int = 2) -> DataFrame:
    """Vocabulary of terms seen at least ``min_count`` times in the
    corpus (the Word2Vec rule), with idf fixed to 1 so ``weigh_counts``
    yields L2-normalised raw counts."""
    tf = counts.groupBy("term").agg(F.sum("c").alias("tf"))
    return tf.filter(F.col("tf") >= min_count).withColumn("idf", F.lit(1.0))


def scores_with_mean_padding(rows: DataFrame, scores: DataFrame, id_col: str, score: str,
                             out: str = "similarity_score_tfidf") -> DataFrame:
    """Attach per-row scores; rows without a score get the mean of the
    scored rows (the reference's padding), 0.0 when nothing is scored."""
    mean = scalar(scores.agg(F.avg(score)), 0.0)
    j = rows.join(scores.select(id_col, F.col(score).alias("__s")), id_col, "left")
    return j.withColumn(out, F.coalesce("__s", F.lit(float(mean)))).drop("__s")

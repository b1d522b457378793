"""Registered queries: tokens, TF-IDF, vectors, pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import MAX_LEN, MIN_LEN, TOKEN_PATTERN, default_stop_words, suffix_lemmas, tokenize
from ..functions.vectors import cosine, dot, pair_vector
from ..operators import tfidf
from ..operators.pair_grid import dot_rows, pair_numbers
from ..operators.topk import topk_sparse_dot
from ..sources import pages, roles
from ..session import scalar
from .catalog import register

r6 = lambda c: F.round(c, 6)

_SW = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words()) + "]"


def _tokens_sql(text: str, stop: bool = True) -> str:
    base = (f"list_filter(regexp_extract_all(strip_accents(lower({text})), '{TOKEN_PATTERN}'), "
            f"lambda x: length(x) BETWEEN {MIN_LEN} AND {MAX_LEN} AND NOT starts_with(x, '_'))")
    return f"list_filter({base}, lambda x: NOT list_contains({_SW}, x))" if stop else base


def _grams_sql(tok: str) -> str:
    return f"list_concat({tok}, list_transform(range(1, len({tok})), lambda i: {tok}[i] || ' ' || {tok}[i + 1]))"


def _vocab_sql(corpus_sql: str, top: int | None = None) -> str:
    """CTE chain (fit) → vocab(term, df, tf, idf) over distinct texts of corpus_sql(text)."""
    cut = f" ORDER BY tf DESC, term LIMIT {top}" if top else ""
    return f"""
fd AS (SELECT DISTINCT text FROM ({corpus_sql}) WHERE text IS NOT NULL),
fn AS (SELECT count(*) AS n FROM fd),
ft AS (SELECT md5(text) AS doc, {_tokens_sql('text')} AS t FROM fd),
fg AS (SELECT doc, unnest({_grams_sql('t')}) AS term FROM ft),
ftf AS (SELECT doc, term, count(*) AS c FROM fg GROUP BY ALL),
fdf AS (SELECT term, count(*) AS df, sum(c) AS tf FROM ftf GROUP BY term),
vocab AS (SELECT term, df, tf, ln((1.0 + n) / (df + 1)) + 1 AS idf FROM fdf, fn
          WHERE df >= 2 AND df <= 0.8 * n{cut})"""


def _weights_sql(name: str, rows_sql: str) -> str:
    """CTEs name_w(id, term, w) for rows_sql(id, text) with the fitted vocab."""
    return f"""
{name}_t AS (SELECT id, {_tokens_sql('text')} AS t FROM ({rows_sql})),
{name}_g AS (SELECT id, unnest({_grams_sql('t')}) AS term FROM {name}_t),
{name}_c AS (SELECT id, term, count(*) AS c FROM {name}_g GROUP BY ALL),
{name}_x AS (SELECT id, term, c * idf AS x FROM {name}_c JOIN vocab USING (term)),
{name}_w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM {name}_x)"""


# ---------------------------------------------------------------- tokens

@register("top_tokens", f"""
WITH t AS (SELECT unnest({_tokens_sql('text', stop=False)}) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM t GROUP BY token),
s AS (SELECT sum(n) AS tot FROM c)
SELECT token, n, round(n / tot, 6) AS share FROM c, s ORDER BY n DESC, token LIMIT 10
""")
def q_top_tokens(spark, d):
    """Ten most frequent tokens with their share of all tokens."""
    docs = roles.table(spark, d, "documents")
    t = docs.select(F.explode(tokenize(F.col("text"))).alias("token"))
    c = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = scalar(c.agg(F.sum("n")), 0)
    return c.orderBy(F.desc("n"), F.asc("token")).limit(10).select("token", "n", r6(F.col("n") / F.lit(total)).alias("share"))


# ---------------------------------------------------------------- TF-IDF

@register("tfidf_terms", f"""
WITH {_vocab_sql('SELECT text FROM documents')}
SELECT term, df, CAST(tf AS BIGINT) AS tf, round(idf, 6) AS idf FROM vocab
""")
def q_tfidf_terms(spark, d):
    """T4: fitted vocabulary over the documents (uni+bigrams, min_df 2,
    max_df 0.8, smooth IDF)."""
    v = tfidf.fit(roles.table(spark, d, "documents"), "text")
    return v.select("term", "df", "tf", r6("idf").alias("idf"))


@register("tfidf_terms_top", f"""
WITH {_vocab_sql('SELECT text FROM documents', 5000)}
SELECT term, df, CAST(tf AS BIGINT) AS tf, round(idf, 6) AS idf FROM vocab
""")
def q_tfidf_terms_top(spark, d):
    """T4 with the reference's feature limit: the 5 000 most frequent terms."""
    v = tfidf.fit(roles.table(spark, d, "documents"), "text", max_features=5000)
    return v.select("term", "df", "tf", r6("idf").alias("idf"))


#: endings that make forms of one word, where the shorter form stands in the corpus too
SUFFIXES = ("s", "es", "ed", "ing", "er", "en", "e", "ion", "ment")
_CUTS = "[" + ", ".join(f"'{x}'" for x in SUFFIXES) + "]"


@register("tfidf_lemmas", f"""
WITH fd AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
fn AS (SELECT count(*) AS n FROM fd),
raw AS (SELECT md5(text) AS doc, {_tokens_sql('text')} AS t FROM fd),
words AS (SELECT doc, unnest(t) AS form, generate_subscripts(t, 1) AS i FROM raw),
forms AS (SELECT DISTINCT form FROM words),
cuts AS (SELECT form, form[:length(form) - length(x)] AS stem
         FROM (SELECT form, unnest({_CUTS}) AS x FROM forms) WHERE ends_with(form, x) AND length(form) - length(x) >= 4),
lem AS (SELECT form, arg_min(stem, length(stem)) AS lemma FROM cuts WHERE stem IN (SELECT form FROM forms) GROUP BY form),
ft AS (SELECT doc, list(coalesce(lemma, form) ORDER BY i) AS t FROM words LEFT JOIN lem USING (form) GROUP BY doc),
fg AS (SELECT doc, unnest({_grams_sql('t')}) AS term FROM ft),
ftf AS (SELECT doc, term, count(*) AS c FROM fg GROUP BY ALL),
fdf AS (SELECT term, count(*) AS df, sum(c) AS tf FROM ftf GROUP BY term)
SELECT term, df, CAST(tf AS BIGINT) AS tf, round(ln((1.0 + n) / (df + 1)) + 1, 6) AS idf
FROM fdf, fn WHERE df >= 2 AND df <= 0.8 * n
""")
def q_tfidf_lemmas(spark, d):
    """T3 in T4: the vocabulary over lemmas.  The lemma table is made from the
    corpus (forms that differ by an ending); any other (form, lemma) table fits."""
    docs = roles.table(spark, d, "documents")
    forms = docs.select(F.explode(tokenize(F.col("text"))).alias("form")).distinct()
    stop = spark.createDataFrame([(w,) for w in default_stop_words()], "form string")
    lemmas = suffix_lemmas(forms.join(stop, "form", "left_anti"), SUFFIXES)
    v = tfidf.fit(docs, "text", lemmas=lemmas)
    return v.select("term", "df", "tf", r6("idf").alias("idf"))


_CONV_ROWS = "SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text FROM conversations"


@register("tfidf_pair_cosine", f"""
WITH {_vocab_sql('SELECT text FROM conversations')},
{_weights_sql('c', _CONV_ROWS)},
p AS (SELECT a.conv_id, a.turn, CAST(a.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS ia,
             CAST(b.conv_id AS VARCHAR) || ':' || CAST(b.turn AS VARCHAR) AS ib
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
dots AS (SELECT p.ia, p.ib, sum(x.w * y.w) AS dot FROM p JOIN c_w x ON x.id = p.ia JOIN c_w y ON y.id = p.ib AND y.term = x.term
         GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(dots.dot, 0.0), 6) AS cosine
FROM p LEFT JOIN dots ON dots.ia = p.ia AND dots.ib = p.ib
""")
def q_tfidf_pair_cosine(spark, d):
    """TF-IDF cosine of consecutive conversation turns (vectorizer
    fitted on the distinct turn texts)."""
    c = roles.table(spark, d, "conversations")
    rows = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    _, w = tfidf.fit_transform(rows, "id", "text")
    a = c.select("conv_id", "turn")
    b = c.select(F.col("conv_id").alias("b_conv"), (F.col("turn") - 1).alias("b_prev"), F.col("turn").alias("b_turn"))
    pairs = (a.join(b, (a.conv_id == b.b_conv) & (a.turn == b.b_prev))
              .select("conv_id", "turn",
                      F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ia"),
                      F.concat_ws(":", F.col("b_conv").cast("string"), F.col("b_turn").cast("string")).alias("ib")))
    out = tfidf.pair_cosine(pairs, w.withColumnRenamed("id", "ia"), w.withColumnRenamed("id", "ib"), "ia", "ib")
    return out.select("conv_id", "turn", r6("cosine").alias("cosine"))


@register("tfidf_query_scores", f"""
WITH {_vocab_sql('SELECT text FROM documents')},
{_weights_sql('d', 'SELECT doc_id AS id, text FROM documents')},
{_weights_sql('q', 'SELECT item_id AS id, text FROM benchmark')},
s AS (SELECT q_w.id AS item_id, d_w.id AS doc_id, round(sum(q_w.w * d_w.w), 9) AS s9
      FROM q_w JOIN d_w ON q_w.term = d_w.term GROUP BY ALL),
a AS (SELECT b.item_id, x.doc_id, coalesce(s.s9, 0.0) AS s9 FROM benchmark b CROSS JOIN documents x
      LEFT JOIN s ON s.item_id = b.item_id AND s.doc_id = x.doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s9 DESC, doc_id) AS INTEGER) AS rank FROM a)
SELECT item_id, rank, doc_id, round(s9, 6) AS score FROM k WHERE rank <= 10
""")
def q_tfidf_query_scores(spark, d):
    """Each benchmark passage as a query against all documents; exact
    top-10 by TF-IDF cosine via threshold rounds (no query × document
    product), always ten: zero scores by smallest id."""
    docs, bench = roles.table(spark, d, "documents"), roles.table(spark, d, "benchmark")
    # a document's other terms count in its norm alone
    asked = tfidf.grams(bench, "item_id", "text").select("term")
    vocab, dw = tfidf.fit_transform(docs, "doc_id", "text", only=asked)
    qw = tfidf.transform(bench, "item_id", "text", vocab)
    top = topk_sparse_dot(qw.select("item_id", F.col("term").alias("key"), F.col("w").alias("qw")),
                          dw.select("doc_id", F.col("term").alias("key"), F.col("w").alias("iw")),
                          10, q_id="item_id", i_id="doc_id", all_queries=bench, all_items=docs)
    return top.select("item_id", "rank", "doc_id", r6("score").alias("score"))


# ---------------------------------------------------------------- embeddings (V*, T16, T17, W14)

_EMB_PAIRS = """
WITH tp AS (SELECT DISTINCT l.l_suppkey AS v, o.o_custkey AS r FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
"""


@register("embedding_pair_sim", _EMB_PAIRS + """
SELECT CAST(tp.v AS VARCHAR) AS vacancy_id, CAST(tp.r AS VARCHAR) AS resume_id,
       round(CASE WHEN a.x IS NULL OR b.x IS NULL THEN 0.0 ELSE list_dot_product(a.x, b.x) END, 6) AS sim
FROM tp LEFT JOIN e a ON a.vec_id = tp.v LEFT JOIN e b ON b.vec_id = tp.r
""")
def q_embedding_pair_sim(spark, d):
    """Embedding similarity of each trade pair, 0.0 when a side
    has no vector."""
    e = roles.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("k"), "embedding")
    out = pair_numbers(roles.trade_pairs(spark, d), e, e, "vacancy_id", "resume_id", {"sim": (dot_rows, dot)}, 0.0, roles.trade_sizes(spark, d))
    return out.select("vacancy_id", "resume_id", r6("sim").alias("sim"))


@register("nearest_rows", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
q AS (SELECT x AS qx, vec_id AS qid FROM e ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(qx, qx) = 0 THEN 0.0
                     ELSE list_dot_product(x, qx) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(qx, qx))) END AS sim
      FROM e, q WHERE vec_id <> qid)
SELECT vec_id, round(sim, 6) AS sim, CAST(row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 10
""")
def q_nearest_rows(spark, d):
    """The 10 rows most cosine-similar to the first row (itself
    excluded by id).  The single query vector is a literal in the plan."""
    e = roles.table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("vec_id", "embedding").limit(1).collect()[0]  # one bounded vector
    qv = F.array(*[F.lit(float(x)) for x in first["embedding"]])
    s = (e.filter(F.col("vec_id") != first["vec_id"])
          .select("vec_id", cosine(F.col("embedding"), qv).alias("sim")))
    from pyspark.sql import Window
    top = s.orderBy(F.desc(F.round("sim", 9)), F.asc("vec_id")).limit(10)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("sim", 9)), F.asc("vec_id"))))
    return top.select("vec_id", r6("sim").alias("sim"), "rank")


@register("pair_vector_features", _EMB_PAIRS + """
SELECT CAST(tp.v AS VARCHAR) AS vacancy_id, CAST(tp.r AS VARCHAR) AS resume_id,
       CAST(len(a.x) * 4 AS INTEGER) AS n_dims,
       round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))), 6) AS l1_diff,
       round(list_dot_product(a.x, b.x), 6) AS dot
FROM tp JOIN e a ON a.vec_id = tp.v JOIN e b ON b.vec_id = tp.r
""")
def q_pair_vector_features(spark, d):
    """V7: [v, r, |v−r|, v·r] per pair with both vectors; reports its size,
    the L1 part and the dot product."""
    e = roles.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("k"), "embedding")

    def features(v, r):
        return np.concatenate([v, r, np.abs(v - r), v * r], axis=1)

    def l1(v, r):
        feats, n = pair_vector(v, r), F.size(v)
        return F.aggregate(F.slice(feats, 2 * n + 1, n), F.lit(0.0), lambda acc, x: acc + x)

    numbers = {"n_dims": (lambda v, r: np.full(len(v), 4.0 * v.shape[1]), lambda v, r: F.size(pair_vector(v, r)).cast("double")),
               "l1_diff": (lambda v, r: features(v, r)[:, 2 * v.shape[1]: 3 * v.shape[1]].sum(1), l1), "dot": (dot_rows, dot)}
    j = pair_numbers(roles.trade_pairs(spark, d), e, e, "vacancy_id", "resume_id", numbers, sizes=roles.trade_sizes(spark, d))
    return j.select("vacancy_id", "resume_id", F.col("n_dims").cast("int").alias("n_dims"), r6("l1_diff").alias("l1_diff"), r6("dot").alias("dot"))


# ---------------------------------------------------------------- pages

@register("page_fields", """
SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host,
       trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title,
       trim(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) AS h1,
       CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS INTEGER) AS n_links,
       CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS INTEGER) AS text_chars
FROM pages
""")
def q_page_fields(spark, d):
    """Typed fields parsed from raw pages."""
    return pages.page_fields(roles.table(spark, d, "pages"))


@register("page_links", """
SELECT href, min(page_id) AS first_page, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
GROUP BY href
""")
def q_page_links(spark, d):
    """List pages → one row per distinct link (0..n rows per page)."""
    return pages.page_links(roles.table(spark, d, "pages"))

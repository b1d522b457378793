"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, fm_index, jaccard_join, line_dedup, mixing, odd_sketch, onebit_ann, periodic_runs, spelling, surrogates, toxicity, wrappers
from .common import ascii_lower, remainder, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return keep


@query("op3_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(er) + 8 + length(et) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                 F.lit(trap))
    done = chat.format_rows(rows.unionAll(more))
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                       chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    loss = F.col("loss")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op4_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_fm_decontaminate", r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT *, least(10, len(w)) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM iw))),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dg JOIN win USING (g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""")
def op7_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_index.digests(fm_index.find_spans(docs, table(spark, sf_dir, "benchmark"), n=10))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), allowed=lambda i: remainder(i, 4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")


@query("op10_wrapper_extract")
def op10_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, threshold=(75, 100))


@query("op8_context_tree")
def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, n_train = ctw.score(docs, remainder(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"),
                         "base_score", "score", "bits_per_byte")


@query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, max_repeat=4.0).drop("text")


@query("op2_pii_surrogates")
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = surrogates.pseudonymise(docs, key="pairmill")
    return done.select("doc_id", "text", F.size("spans").cast("bigint").alias("n_replaced"))


@query("op6_onebit_ann")
def op6_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return onebit_ann.search(rows, F.col("vec_id") % 50 == 0, k=5)


#: unsigned crc32 of the UTF-8 bytes of ``{0}`` in SQL; ``crc_table`` holds the 256 remainders
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({0}))),
  lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


@query("op12_periodic_runs", r"""
WITH """ + CRC_TABLE + r""",
d AS (SELECT doc_id, """ + CRC.format("CAST(doc_id AS VARCHAR)") + r""" AS h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w
  FROM documents, crc_table),
p AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM d),
e AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
    CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM p),
k AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT *, unnest(range(n - 4)) AS i FROM e WHERE n >= 5)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o, i FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS n FROM island GROUP BY doc_id, q, o),
run AS (SELECT doc_id, s, n, min(q) AS q FROM stretch WHERE n >= greatest(6, 4 * q) GROUP BY doc_id, s, n),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(n AS DOUBLE) / q DESC, s, q) = 1),
all_runs AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM e) x
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM e LEFT JOIN all_runs USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(with_planted_runs(docs), exponent=4, shortest=6)
    exact = lambda x: x["length"].cast("decimal(20,0)")
    # the greater exponent first, by cross products; then the smaller start and period
    better = lambda x, y: exact(x) * y["period"] > exact(y) * x["period"]
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                       lambda top, x: F.when(top.isNull() | better(x, top), x).otherwise(top))
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","),
                              x["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts (crc32 of the id divisible by ten) repeat one stretch of words up to their end."""
    h = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    at = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    # guarded by n > 0, where the remainder is defined
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return at.select("doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


@query("op13_spelling_variants", r"""
WITH RECURSIVE """ + CRC_TABLE + r""",
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
k AS (SELECT CAST(doc_id AS VARCHAR) || ':' || run AS s, run, count(*) AS n FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, """ + CRC.format("s") + r""" AS h FROM k, crc_table),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(CAST(length(word) AS INT))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (SELECT near.word, count(*) AS n_near, first(near.near ORDER BY b.n DESC, near.near) AS top, max(b.n) AS top_n
  FROM near JOIN words b ON b.word = near.near GROUP BY near.word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form, CASE WHEN top_n >= 10 * n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT follow.word, formed.form FROM follow JOIN formed ON formed.word = follow.root WHERE form IS NOT NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN (SELECT follow.word, root FROM follow JOIN formed ON formed.word = root WHERE form IS NULL) USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = damaged_words(table(spark, sf_dir, "documents").select("doc_id", "text"), 7)
    return spelling.group_variants(words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"), ratio=10)


def damaged_words(docs: DataFrame, shortest: int) -> DataFrame:
    """``word``: the letter runs of all texts, of which one in 31 (by the crc32 of id and run) loses a letter, if ``shortest`` letters are left."""
    runs = F.regexp_extract_all(ascii_lower(text_of(docs)), F.lit(f"[a-z\u00C0-\u00FF]{{{shortest},}}"), F.lit(0))
    found = docs.select("doc_id", F.explode(runs).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.call_function("substring", F.col("run"), at + 2))
    words = found.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest)


@query("op11_odd_sketch", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(doc_id, other) AS (SELECT a, b FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
least AS (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(w.doc_id, least.least), w.doc_id) AS component_id,
  w.doc_id = coalesce(least(w.doc_id, least.least), w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
""")
def op11_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = odd_sketch.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, threshold=(85, 100))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Spelling variant grouping: a frontier of (word, position, node, edits) states joined with a trie, level by level.

The trie holds every word twice, forwards and backwards (a mark in front tells
them apart), as a distributed table of edges (``node``, ``letter``): a node is
its prefix.  An edit in the second half of a word leaves the first half as it
is, and one in the first half does so backwards, so a word enters the frontier
at the node of its half, where few branches are left.

At each level, the words' own nodes (no edit) and the states with one edit are
joined with the edges that leave nodes of that depth:

* no edit: a letter other than the word's is a replacement (of the pair, from
  the smaller letter) or an insertion.  A deletion is the other word's
  insertion, so both are found by insertions.
* one edit: the word's next letter must be there.

An edge also tells which letters can follow it (64 bits, so other letters may
pass) and whether a word ends there.  A state whose next letter cannot follow
is not written.  A state at the end of its word, where a word ends with one
edit, is a neighbour.

Words of more than ``LONG`` letters would need as many levels; they are joined
by all of the word but one of ``PARTS`` parts, and compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Letters of a word in the trie at most, and parts of longer ones.
LONG, PARTS = 64, 16


def _letter(s: Column | str, at: Column) -> Column:
    """The letter at a place counted from 0 behind the mark; empty at the end."""
    return F.substring(s, at + 2, F.lit(1))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(letter) % 64)


def both_ways(words: DataFrame) -> DataFrame:
    """``s``: each word behind ``>``, and reversed behind ``<``; ``size``, and ``enter``, the depth of its half."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    ways = F.array(F.struct(F.concat(F.lit(">"), "word").alias("s"), half.alias("enter")),
                   F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("s"), (size - half).alias("enter")))
    return words.select(F.explode(ways).alias("x"), size.alias("size")).select("x.s", "x.enter", "size")


def edges(ways: DataFrame, lowest: int) -> DataFrame:
    """Edges of the trie that leave nodes of depth ``lowest`` or more: ``depth``, ``node``, ``letter``, ``after``, ``ends``."""
    steps = ways.where(F.col("size") > lowest).select("s", F.explode(F.sequence(F.lit(lowest), F.col("size") - 1)).alias("depth"))
    after = _letter(F.col("s"), F.col("depth") + 1)
    return (steps.select("depth", F.substring(F.col("s"), F.lit(1), F.col("depth") + 1).alias("node"),
                         _letter(F.col("s"), F.col("depth")).alias("letter"), after.alias("next"))
            .groupBy("depth", "node", "letter")
            .agg(F.bit_or(F.when(F.col("next") == "", F.lit(0).cast("bigint")).otherwise(_bit(F.col("next")))).alias("after"),
                 F.bool_or(F.col("next") == "").alias("ends")))


def step(states: DataFrame, level: DataFrame) -> DataFrame:
    """The states behind ``states`` at nodes of one depth, by the edges of that ``level``."""
    x = states.join(level, "node")
    pos, size, letter = F.col("position"), F.length("s") - 1, F.col("letter")
    mine = _letter(F.col("s"), pos)

    def goes_on(at: Column) -> Column:
        """Whether the word's letter at ``at`` can follow the edge, or the word and one of the trie end there."""
        need = _letter(F.col("s"), at)
        return F.when(need == "", F.col("ends")).otherwise(F.col("after").bitwiseAND(_bit(need)) != 0)

    new = F.array_compact(F.array(
        F.when((F.col("edits") == 0) & (pos < size) & (letter > mine) & goes_on(pos + 1), pos + 1),
        F.when((F.col("edits") == 0) & (letter != mine) & goes_on(pos), pos),
        F.when((F.col("edits") == 1) & (letter == mine) & goes_on(pos + 1), pos + 1)))
    return x.select("s", F.explode(new).alias("position"), F.concat("node", "letter").alias("node"), F.lit(1).alias("edits"))


def _word(marked: Column) -> Column:
    bare = F.call_function("substring", marked, F.lit(2))
    return F.when(F.substring(marked, 1, 1) == "<", F.reverse(bare)).otherwise(bare)


def trie_neighbours(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Pairs ``a``, ``b`` of words one edit apart, each once or twice, of words of so many letters."""
    lowest = shortest // 2
    ways = staged(both_ways(words), "spelling-ways")
    # by depth, so that a level reads its own part of the files
    table = staged(edges(ways, lowest).repartitionByRange("depth", "node").sortWithinPartitions("depth", "node"), "spelling-edges")
    at_end = F.col("position") == F.length("s") - 1
    frontier, done = None, []
    for depth in range(lowest, longest + 1):
        own = (ways.where((F.col("enter") <= depth) & (F.col("size") >= depth))
               .select("s", F.lit(depth).alias("position"), F.substring("s", 1, depth + 1).alias("node"), F.lit(0).alias("edits")))
        states = own if frontier is None else own.unionByName(frontier.where(~at_end))
        frontier = staged(step(states, table.where(F.col("depth") == depth).drop("depth")), "spelling-frontier")
        done.append(frontier.where(at_end).select(_word(F.col("s")).alias("a"), _word(F.col("node")).alias("b")))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def long_neighbours(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of words one edit apart, of ``LONG`` letters or more.

    One edit lies in one part of the shorter word; all before and behind it is the same.
    """
    size = F.length("word")
    sizes = words.select("word", F.explode(F.array(size, size - 1)).alias("least"))
    parts = sizes.select("word", "least", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    start = F.floor(F.col("least") * F.col("part") / PARTS).cast("int")
    stop = F.floor(F.col("least") * (F.col("part") + 1) / PARTS).cast("int")
    behind = F.col("least") - stop
    keyed = parts.select("word", "least", F.xxhash64(
        "least", "part", F.substring(F.col("word"), F.lit(1), start),
        F.substring(F.col("word"), F.length("word") - behind + 1, behind)).alias("key"))
    a = keyed.where(F.length("word") == F.col("least")).select(F.col("word").alias("a"), "key", "least")
    b = keyed.select(F.col("word").alias("b"), "key", "least")
    pairs = a.join(b, ["key", "least"]).where((F.col("a") != F.col("b")) & ((F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))))
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``near``: all pairs of the distinct words, in both directions, that one inserted, deleted or replaced letter tells apart."""
    bounds = words.agg(F.min(F.length("word")), F.max(F.length("word"))).collect()[0]
    pairs = []
    if bounds[0] is not None and bounds[0] <= LONG:
        pairs.append(trie_neighbours(words.where(F.length("word") <= LONG), bounds[0], min(bounds[1], LONG)))
    if bounds[0] is not None and bounds[1] > LONG:
        pairs.append(long_neighbours(words.where(F.length("word") >= LONG)))
    if not pairs:
        return words.select("word", F.col("word").alias("near"))  # no words, no pairs
    found = pairs[0] if len(pairs) == 1 else pairs[0].unionAll(pairs[1])
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    return found.select(F.explode(ends).alias("x")).select("x.word", "x.near").distinct()


def group_variants(counts: DataFrame, ratio: int = 10, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for each distinct word.

    Words are near if exactly one code point, inserted, deleted or replaced,
    tells them apart.  ``form``: the near word of largest ``n``, among equals the
    smallest in code-point order, if its ``n`` is at least ``ratio`` times the
    word's; else null.  ``root``: where following forms from the word ends, the
    word itself if it has no form.  Repeated words are one word, their ``n``
    added up, where a null ``n`` is 0; a word without occurrences is no form.
    Null words are left out; the empty word is a word.  Other columns of
    ``counts`` are not read.  An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as frequent, or following them need not end")
    words = counts.select(F.col(word_col).cast("string").alias("word"), F.coalesce(F.col(n_col).cast("bigint"), F.lit(0)).alias("n"))
    words = staged(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    pairs = neighbours(words.select("word"))
    sized = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    takes = (F.col("top.less") < 0) & (-F.col("top.less") >= ratio * F.col("n"))
    formed = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("top.near")).alias("form"),
        F.when(takes, -F.col("top.less")).alias("form_n")), "spelling-forms")
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    # n grows by the ratio along forms, from 0 to 1 once, so a chain is short; each round doubles what is followed
    most = formed.agg(F.max("n")).collect()[0][0] or 1
    for _ in range(math.ceil(math.log2(math.log(max(most, 1), ratio) + 2))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent and normalised; 1 keeps
the shares, 0 makes all sources equal.  The exponent is found by halving an
interval until the weights have a wanted entropy, or until no source is
repeated more often than a limit.  The weights times a budget say how many
tokens of each source go into the mix, and they are realised as passes: whole
passes over all of a source's blocks, each in a keyed order of its own, and a
last pass that ends where the budget does.

A source's figures come from partial sums by block, so a source that holds a
third of all rows is summed in many tasks.  Halving runs on sums over the table
of sources, sixteen parts of the interval in one job, so the number of sources
is not bounded by the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, staged

#: Blocks of a source (a power of two), and parts of the interval in a job.
BLOCKS, PARTS = 4096, 16
#: The exponent's interval is halved until it is shorter than this.
PRECISION = 2.0**-36


def token_count(text: Column) -> Column:
    """White space separated words of a text; null and empty texts have none."""
    found = F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return found.cast("bigint")


def block_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's block inside its source: a hash of its id and text, so equal rows share one."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, text), F.lit(BLOCKS)).cast("int")


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of powers, sum of powers times logarithm, and the largest repetition a token budget of 1 makes.

    Shares are taken of the largest source, so that powers stay in range.
    """
    x = F.log("share")
    aggs = []
    for k, a in enumerate(exponents):
        p = F.exp(F.lit(a) * x)
        aggs += [F.sum(p).alias(f"z{k}"), F.sum(p * x).alias(f"l{k}"), F.max(F.exp(F.lit(a - 1) * x)).alias(f"r{k}")]
    row = sources.agg(*aggs).collect()[0]
    return [(row[f"z{k}"], row[f"l{k}"], row[f"r{k}"]) for k in range(len(exponents))]


def _last_true(sources: DataFrame, holds) -> float:
    """The least exponent in [0, 1] for which ``holds(a, z, l, r)`` is true; it is true from there on up."""
    low, high = 0.0, 1.0
    if holds(0.0, *_sums(sources, [0.0])[0]):
        return 0.0
    while high - low > PRECISION:
        at = [low + (high - low) * k / PARTS for k in range(1, PARTS)]
        ok = [holds(a, *s) for a, s in zip(at, _sums(sources, at))]
        k = ok.index(True) if True in ok else len(at)
        low, high = (at[k - 1] if k else low), (at[k] if k < len(at) else high)
    return high


def exponent_for(sources: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None,
                 budget: float | None = None) -> float:
    """The exponent that flattens the shares most within the limits.

    ``sources`` has ``share``, the tokens over those of the largest source.
    ``target_entropy``: of the weights, as a part of that of equal weights; a
    value below that of the shares themselves gives exponent 1.
    ``max_repeat``: how often the mix may see a token of any source, for
    ``budget`` tokens in units of the largest source, or, without a budget,
    for the least mix that sees all tokens of the largest source once.
    """
    bounds = [0.0]
    if target_entropy is not None:
        n = sources.count()
        wanted = target_entropy * math.log(n) if n else 0.0
        bounds.append(_last_true(sources, lambda a, z, s, r: math.log(z) - a * s / z <= wanted + 1e-12))
    if max_repeat is not None:
        scale = lambda z: budget / z if budget is not None else 1.0
        bounds.append(_last_true(sources, lambda a, z, s, r: r * scale(z) <= max_repeat * (1 + 1e-12)))
    if target_entropy is None and max_repeat is None:
        return 1.0
    return max(bounds)


def _block_totals(docs: DataFrame, source: str, block: str, tokens: str) -> DataFrame:
    # partial sums by block: a large source is added up in many tasks
    return staged(docs.groupBy(F.col(source).alias("source"), F.col(block).alias("block"))
                  .agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows")), "mix-blocks")


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        target_entropy: float | None = None, max_repeat: float | None = 4.0, budget_tokens: int | None = None,
        seed: int = 17) -> DataFrame:
    """``docs`` plus the mix: ``n_tokens``, ``weight``, ``budget``, ``whole_passes``, ``in_last_pass`` and ``copies``.

    ``copies`` of a row: the whole passes over its source, and one more if its
    place in the last pass comes before the budget ends.  The row that the end
    falls into still counts.  Without ``budget_tokens`` the budget is the least
    at which every source is seen whole at least once; so no row is lost.

    The columns are added, and replace ones of these names.  A null source is a
    source of its own.  Rows without tokens ride along: they take part in every
    whole pass of their source, and in the last one by their place.  A source
    without any tokens has weight 0 and one whole pass if no budget is given,
    none otherwise.  Equal rows share a place in every pass and so are taken or
    left together.  An empty table gives no rows.
    """
    out = docs.drop("n_tokens", "weight", "budget", "whole_passes", "in_last_pass", "copies")
    block, order = free_names([*out.columns, "n_tokens", "weight", "budget", "whole_passes", "in_last_pass", "copies"], "block", "order")
    text = F.coalesce(out[text_col].cast("string"), F.lit(""))
    full = (out.withColumn("n_tokens", token_count(out[text_col])).withColumn(block, block_of(out[id_col], text, seed))
            .withColumn(order, F.xxhash64(F.lit(seed + 1), out[id_col], text)))
    totals = _block_totals(full, source_col, block, "n_tokens")
    sums = totals.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("block", "tokens"))).alias("blocks"))
    sources = staged(sums, "mix-sources")
    plan, _ = plan_sources(sources, target_entropy, max_repeat, budget_tokens, seed)
    plan = staged(plan, "mix-plan")
    s, b = free_names([*full.columns, "weight", "budget", "whole_passes", "in_last_pass", "copies"], "src", "cut")
    told = plan.select(F.col("source").alias(s), "weight", "budget", "whole_passes", "multiply", "shift", F.col("cut").alias(b), "left")
    joined = full.join(told, full[source_col].eqNullSafe(told[s]), "left")
    place = place_of(F.col(block), F.col("multiply"), F.col("shift"))
    # only the block in which the last pass ends is cut by document
    edge = joined.where(place == F.col(b)).groupBy(F.col(source_col).alias("source"), F.col(order).alias("at")).agg(F.sum("n_tokens").alias("tokens"))
    edge = _prefix(edge).join(plan.select(F.col("source").alias(s), "left"), F.col("source").eqNullSafe(F.col(s)))
    last = staged(edge.where("before < left").groupBy("source").agg(F.max("at").alias("until")), "mix-edge")
    e, u = free_names([*joined.columns, "in_last_pass", "copies"], "edge_source", "until")
    done = joined.join(last.select(F.col("source").alias(e), F.col("until").alias(u)), F.col(source_col).eqNullSafe(F.col(e)), "left")
    inside = (place < F.col(b)) | ((place == F.col(b)) & (F.col(order) <= F.col(u)))
    return (done.withColumn("in_last_pass", F.coalesce(inside, F.lit(False)))
            .withColumn("copies", F.col("whole_passes") + F.col("in_last_pass").cast("bigint"))
            .select(*out.columns, "n_tokens", "weight", "budget", "whole_passes", "in_last_pass", "copies"))


def place_of(block: Column, multiply: Column, shift: Column) -> Column:
    """A permutation of the blocks: an odd factor and a shift, modulo their number."""
    return F.pmod(block.cast("bigint") * multiply + shift, F.lit(BLOCKS))


def plan_sources(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget_tokens: int | None,
                 seed: int) -> tuple[DataFrame, float]:
    """For each source: weight, budget, whole passes, and where in its last pass' block order the budget ends."""
    top = sources.agg(F.max("tokens").alias("top"), F.sum("tokens").alias("all")).collect()[0]
    largest = top["top"] or 0
    shares = staged(sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(max(1, largest)))).alias("share")), "mix-shares")
    if not largest:
        alpha, z = 1.0, 1.0
    else:
        alpha = exponent_for(shares, target_entropy, max_repeat, None if budget_tokens is None else budget_tokens / largest)
        z = _sums(shares, [alpha])[0][0]
    share = F.col("tokens") / F.lit(float(max(1, largest)))
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(alpha) * F.log(share)) / F.lit(z)).otherwise(F.lit(0.0))
    # without a budget, the largest source is seen exactly once: the budget is its tokens over its weight
    total = float(budget_tokens) if budget_tokens is not None else largest * z
    budget = F.round(F.col("weight") * F.lit(total)).cast("bigint")
    plan = sources.withColumn("weight", weight).withColumn("budget", budget)
    empty = F.lit(1 if budget_tokens is None else 0).cast("bigint")
    plan = plan.withColumn("whole_passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(empty).cast("bigint"))
    plan = plan.withColumn("left", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole_passes") * F.col("tokens")).otherwise(F.lit(0)).cast("bigint"))
    key = F.xxhash64(F.lit(seed), F.col("source"), F.col("whole_passes"))
    plan = (plan.withColumn("multiply", F.pmod(key, F.lit(BLOCKS // 2)) * 2 + 1)
            .withColumn("shift", F.pmod(F.shiftright(key, 20), F.lit(BLOCKS))))
    # at most BLOCKS blocks a source: running sums in the keyed order, inside one row
    placed = F.sort_array(F.transform("blocks", lambda x: F.struct(
        place_of(x["block"], F.col("multiply"), F.col("shift")).alias("place"), x["tokens"].alias("tokens"))))
    plan = plan.withColumn("placed", placed)
    reached = F.aggregate(
        "placed", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("before")),
        lambda s, x: F.struct((s["sum"] + x["tokens"]).alias("sum"),
                              F.when(s["sum"] < F.col("left"), x["place"]).otherwise(s["cut"]).alias("cut"),
                              F.when(s["sum"] < F.col("left"), s["sum"]).otherwise(s["before"]).alias("before")))
    plan = plan.withColumn("reached", reached)
    # what is left of the budget when the block begins in which it ends
    return plan.select("source", "tokens", "weight", "budget", "whole_passes", "multiply", "shift",
                       F.col("reached.cut").alias("cut"), (F.col("left") - F.col("reached.before")).alias("left")), alpha


def _prefix(edge: DataFrame) -> DataFrame:
    """``before``: tokens of the rows before, in the order of ``at``, inside the one cut block of each source."""
    from pyspark.sql import Window
    w = Window.partitionBy("source").orderBy("at")
    return edge.withColumn("before", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))


def passes(mixed: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """The mix itself: one row for each copy, with ``pass`` (from 0) and ``position`` (0 to 1).

    Sorting by ``position`` interleaves the sources by their weights: a copy's
    position is its pass, and its block's place in that pass, over the passes
    of its source.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = mixed.withColumn("pass", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))))
    key = F.xxhash64(F.lit(seed), F.col(source_col), F.col("pass"))
    place = place_of(block_of(F.col(id_col), text, seed), F.pmod(key, F.lit(BLOCKS // 2)) * 2 + 1, F.pmod(F.shiftright(key, 20), F.lit(BLOCKS)))
    total = F.greatest(F.col("whole_passes") + F.lit(1), F.lit(1))
    return rows.withColumn("position", (F.col("pass") + place / F.lit(BLOCKS)) / total)

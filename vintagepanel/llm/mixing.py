"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent between 0 (all alike) and 1 (as they
are) and normalised. The exponent is found by bisection, in 32 parts a pass, each pass an
aggregation over the table of sources: the largest that still has the target entropy, or
the smallest that keeps to the repetition limit. Weights become budgets of tokens, budgets
become passes over a source, each in its own permutation, the last one cut where the
budget ends. Emitted copies are laid out in blocks, and every block holds each source in
its weight, permuted within the block.

A permutation is the order of a hash of row and pass, so a row's place in it needs no
sorting: token counts and hashes alone are summed over slices of the hash line, the slice
in which a budget ends is cut finer until one hash is left, and every row then sees from
its own hash whether it is emitted and how far along the source it stands. Texts are read
once more to be emitted and are never shuffled.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vintagepanel.llm.common import salted_join, scratch_table, small_or_shuffled, text_of

_PARTS, _PASSES = 32, 8
#: Bits of a row's place in a permutation; bits of slices at most, rows of a slice about; sources that are broadcast.
PLACE_BITS, SLICE_BITS, SLICE_ROWS, BROADCAST_SOURCES = 62, 10, 10_000, 100_000


def count_tokens(text: Column) -> Column:
    """Words of a text, at least one, so that every row has a weight."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)).cast("long")


@dataclass
class Mixture:
    """The exponent, the budget in tokens, and a table of sources: source, tokens, n_docs, weight, repeats."""

    exponent: float
    budget: float
    sources: DataFrame
    n_sources: int
    n_docs: int


def _bisect(holds: Callable[[list[float]], list[bool]], low: float = 0.0, high: float = 1.0) -> tuple[float, float]:
    """The bracket in which a condition that fails at first and then holds begins to hold. holds: for many points at once."""
    for _ in range(_PASSES):
        points = [low + (high - low) * i / _PARTS for i in range(1, _PARTS)]
        answers = holds(points)
        i = next((i for i, a in enumerate(answers) if a), len(points))
        low, high = (points[i - 1] if i else low), (points[i] if i < len(points) else high)
        if high - low < 1e-12:
            break
    return low, high


def _at(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent, the sum of p^a and the entropy of the normalised weights."""
    a = F.explode(F.array(*[F.lit(x) for x in exponents]))
    each = shares.select("p", a.alias("a")).withColumn("x", F.pow("p", "a"))
    rows = each.groupBy("a").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.ln("p")).alias("s")).collect()
    return {r["a"]: (r["z"], math.log(r["z"]) - r["a"] * r["s"] / r["z"]) for r in rows}


def plan(counted: DataFrame, target_entropy: float | None = None, max_repeats: float = 2.0, budget: float | None = None) -> Mixture:
    """Weights for counted (source, tokens). budget: tokens to emit; unset, the least repeated source gets one whole pass, so no row is lost.

    A null source is a source of its own; rows alike each count; tokens are at least 1 and
    not null. An empty table gives a mixture without sources.
    """
    totals = scratch_table(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "sources")
    whole = totals.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.count("*").alias("n"), F.sum("n_docs").alias("docs")).first()
    if not whole["n"]:
        return Mixture(1.0, 0.0, totals.withColumns({"weight": F.lit(0.0), "repeats": F.lit(0.0)}), 0, 0)
    t, low, high = whole["t"], whole["low"], whole["high"]
    shares = totals.select((F.col("tokens") / t).alias("p"))

    def largest_repeats(a: float, z: float) -> float:
        return (budget / t) * (low / t) ** (a - 1) / z if budget else (high / low) ** (1 - a)

    if target_entropy is not None:
        # entropy falls as the exponent grows: the largest exponent that still has it
        def uneven(xs: list[float]) -> list[bool]:
            found = _at(shares, xs)
            return [found[x][1] < target_entropy for x in xs]

        exponent = 1.0 if not uneven([1.0])[0] else _bisect(uneven)[0]
    else:
        def within(xs: list[float]) -> list[bool]:
            found = _at(shares, xs)
            return [largest_repeats(x, found[x][0]) <= max_repeats + 1e-12 for x in xs]

        # with a budget beyond the limit even at 1, the shares stay as they are
        exponent = 0.0 if within([0.0])[0] else _bisect(within)[1]
    z = _at(shares, [exponent])[exponent][0]
    if not budget:
        budget = t * z * (high / t) ** (1 - exponent)
    weight = F.pow(F.col("tokens") / t, F.lit(exponent)) / z
    sources = totals.withColumn("weight", weight).withColumn("repeats", F.col("weight") * budget / F.col("tokens"))
    return Mixture(exponent, budget, sources, whole["n"], whole["docs"])


def _source_key(source: Column) -> Column:
    """A string for each source, null included."""
    return F.to_json(F.struct(source.alias("s")))


def _row_hash(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(docs[f"`{id_col}`"], F.xxhash64(docs[f"`{text_col}`"]), F.lit(seed))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """source, tokens and hash of every row, without its text; written to the shared folder."""
    tokens = count_tokens(text_of(f"`{text_col}`"))
    return scratch_table(docs.select(docs[f"`{source_col}`"].alias("source"), tokens.alias("tokens"), _row_hash(docs, id_col, text_col, seed).alias("h")), "measured")


def place_in(h: Column, nth: Column) -> Column:
    """The place of a row in the permutation of a pass: PLACE_BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(h, nth), 64 - PLACE_BITS)


def _prefix(place: Column, bits: Column) -> Column:
    return F.call_function("shiftright", place, F.lit(PLACE_BITS) - bits)


def _slices(measured: DataFrame, side: DataFrame, n_sources: int) -> DataFrame:
    """_k, pass, prefix, sum, before: tokens of each slice of each permutation, and of the slices ahead of it."""
    rows = salted_join(measured.select(_source_key(F.col("source")).alias("_k"), "tokens", "h"), side.select("_k", "passes", "bits"), "_k", n_sources, BROADCAST_SOURCES, "inner")
    each = rows.filter("passes > 0").select("_k", "tokens", "h", "bits", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    sums = each.groupBy("_k", "pass", _prefix(place_in(F.col("h"), F.col("pass")), F.col("bits")).alias("prefix")).agg(F.sum("tokens").alias("sum"))
    ahead = F.sum("sum").over(W.partitionBy("_k", "pass").orderBy("prefix")) - F.col("sum")
    return scratch_table(sums.withColumn("before", ahead), "slices")


def _ends_here() -> Column:
    return (F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("sum"))


def _narrowed(measured: DataFrame, at: DataFrame, n_sources: int, bits: Column) -> DataFrame:
    """The slice of the given, larger number of bits in which a source's budget ends, within the one in `at` (_k, pass, left, bits, prefix, before)."""
    rows = salted_join(measured.select(_source_key(F.col("source")).alias("_k"), "tokens", "h"), at, "_k", n_sources, BROADCAST_SOURCES, "inner")
    place = place_in(F.col("h"), F.col("pass"))
    within = rows.filter(_prefix(place, F.col("bits")) == F.col("prefix"))
    sums = within.groupBy("_k", "pass", "left", "before", bits.alias("bits"), _prefix(place, bits).alias("prefix")).agg(F.sum("tokens").alias("sum"))
    ahead = F.sum("sum").over(W.partitionBy("_k").orderBy("prefix")) - F.col("sum")
    return sums.withColumn("before", F.col("before") + ahead).filter(_ends_here()).drop("sum")


def mix(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = 1 << 20, seed: int = 0, measured: DataFrame | None = None) -> DataFrame:
    """A row per emitted copy: row (struct of all columns of docs), pass, tokens, weight, block, place.

    Passes count from 0. A copy is emitted in the last, partial pass if the tokens before
    it in that pass's permutation are fewer than what is left of the budget. block is the
    block of about block_tokens tokens in which the copy stands, place its order within.
    Null sources form a source of their own; null and empty texts, and texts without
    words, weigh one token. A row's place follows from its id and text, so null ids do no
    harm; rows alike in both are emitted or cut together. Other columns ride along,
    whatever their names. An empty table gives no rows. measured: what measure() gave for
    these docs and this seed.
    """
    measured = measure(docs, id_col, text_col, source_col, seed) if measured is None else measured
    # a hair's breadth of rounding must not open a pass of one row
    passes = F.greatest(F.ceil(F.col("repeats") - 1e-9), F.lit(0)).cast("int")
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n_docs") / SLICE_ROWS)), F.lit(0)), F.lit(SLICE_BITS)).cast("int")
    side = mixture.sources.select(_source_key(F.col("source")).alias("_k"), F.col("tokens").alias("_total"), "weight", "repeats", passes.alias("passes"), bits.alias("bits"))
    n = mixture.n_sources
    slices = _slices(measured, side, n)
    left = (F.col("repeats") - F.col("passes") + 1) * F.col("_total") - 1e-6
    at = slices.join(small_or_shuffled(side.select("_k", "bits", "passes", left.alias("left")), n, BROADCAST_SOURCES), "_k").filter(F.col("pass") == F.col("passes") - 1)
    at = at.filter(_ends_here()).select("_k", "pass", "left", "bits", "prefix", "before")
    finer = _narrowed(measured, scratch_table(at, "ends"), n, F.col("bits") + SLICE_BITS)
    last = _narrowed(measured, scratch_table(finer, "ends"), n, F.lit(PLACE_BITS)).select("_k", F.col("prefix").alias("_last"))
    side = scratch_table(side.join(last, "_k", "left"), "budgets")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _source_key(docs[f"`{source_col}`"]).alias("_k"), count_tokens(text_of(f"`{text_col}`")).alias("tokens"), _row_hash(docs, id_col, text_col, seed).alias("_h"))
    joined = salted_join(rows, side, "_k", n, BROADCAST_SOURCES, "inner").filter("passes > 0")
    copies = joined.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("_place", place_in(F.col("_h"), F.col("pass")))
    kept = copies.filter((F.col("pass") < F.col("passes") - 1) | (F.col("_place") <= F.coalesce("_last", F.lit(-1)))).withColumn("prefix", _prefix(F.col("_place"), F.col("bits")))
    placed = kept.join(small_or_shuffled(slices, slices.count(), BROADCAST_SOURCES), ["_k", "pass", "prefix"])
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(PLACE_BITS) - F.col("bits"))
    along = F.col("before") + F.col("sum") * ((F.col("_place") - F.col("prefix") * span) / span)
    allowed = F.col("repeats") * F.col("_total")
    blocks = max(1, math.ceil(mixture.budget / block_tokens))
    block = F.least(F.floor((F.col("pass") * F.col("_total") + along) / allowed * blocks), F.lit(blocks - 1))
    return placed.select("row", "pass", "tokens", "weight", block.alias("block"), F.xxhash64("_place", F.lit(seed)).alias("place"))


def mixed_documents(docs: DataFrame, max_repeats: float = 2.0) -> DataFrame:
    """The emitted copies with the columns of docs: each row once, rows of smaller sources again. Nulls and odd rows as in mix()."""
    measured = measure(docs)
    return mix(docs, plan(measured, max_repeats=max_repeats), measured=measured).select("row.*")


def op6(spark: SparkSession, docs: DataFrame, max_repeats: float) -> DataFrame:
    """doc_id, source, pass, tokens, weight, block, slot (place in the block, from 0) of every emitted copy. Nulls and odd rows as in mix()."""
    docs = docs.select("doc_id", "text", "source")
    measured = measure(docs)
    mixed = mix(docs, plan(measured, max_repeats=max_repeats), measured=measured)
    slot = F.row_number().over(W.partitionBy("block").orderBy("place", "row.doc_id", "pass")) - 1
    return mixed.select("row.doc_id", "row.source", "pass", "tokens", "weight", "block", slot.cast("long").alias("slot"))

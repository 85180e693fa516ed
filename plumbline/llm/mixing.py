"""Temperature mixing of sources, with DataFrame functions only.

Token shares of the sources are raised to an exponent found by bisection, so that the mix
reaches a target entropy or stays within a limit of repetitions; the weights are then realised
as budgeted block permutations. A source is cut into hashed blocks of bounded size: each
block is permuted and has its own share of the budget, so no task ever orders a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import split_join, whole_text, written

#: Bisection steps, and how many of them one Spark job answers (it sums at all points they can visit).
STEPS, STEPS_PER_JOB = 30, 6

#: Sources whose totals may be broadcast.
BROADCAST_SOURCES = 100_000



def source_key(source: Column) -> Column:
    """A text for each source; the null source is a source of its own, unlike any other."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit(""))


def word_tokens(text: Column) -> Column:
    """Words of a text, and 1 at least: every document costs something."""
    return F.greatest(F.size(F.regexp_extract_all(text, F.lit(r"([^\x09-\x0D\x20]+)"), 1)), F.lit(1)).cast("long")


def hash60(*parts) -> Column:
    """60 bits of the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sums(totals: DataFrame, points: list[float]) -> dict[int, tuple[float, float]]:
    """For each exponent a: sum of p^a and of p^a ln p over the sources."""
    grid = totals.select("share", F.posexplode(F.array(*map(F.lit, points))).alias("i", "a"))
    x = F.pow("share", "a")
    return {r["i"]: (r["z"], r["y"]) for r in grid.groupBy("i").agg(F.sum(x).alias("z"), F.sum(x * F.log("share")).alias("y")).collect()}


def bisect_exponent(
    totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None
) -> float:
    """The exponent in 0..1 that meets the target; ``totals`` has ``share`` > 0 for each source.

    ``target_entropy`` is a part (0..1) of the largest possible entropy. ``max_repeats`` bounds
    how often any source is repeated: the flattest mix within it is taken. Both fall as the
    exponent grows. ``budget`` is in units of all tokens; None is the smallest that holds every
    source whole.
    """
    lo, hi = 0.0, 1.0
    bounds = totals.agg(F.min("share").alias("least"), F.max("share").alias("most"), F.count(F.lit(1)).alias("n")).collect()[0]
    if not bounds["n"] or (target_entropy is None and max_repeats is None):
        return 1.0

    def too_flat(a: float, z: float, y: float) -> bool:
        if target_entropy is not None:
            return math.log(z) - a * y / z > target_entropy * math.log(bounds["n"])
        scale = z * bounds["most"] ** (1 - a) if budget is None else budget
        return scale * bounds["least"] ** (a - 1) / z > max_repeats * (1 + 1e-12)

    for _ in range(STEPS // STEPS_PER_JOB):
        n = 1 << STEPS_PER_JOB
        points = [lo + (hi - lo) * i / n for i in range(1, n)]
        at = _sums(totals, points)
        left, right = 0, n
        while right - left > 1:
            mid = (left + right) // 2
            if too_flat(points[mid - 1], *at[mid - 1]):
                left = mid
            else:
                right = mid
        lo, hi = lo + (hi - lo) * left / n, lo + (hi - lo) * right / n
    return round(hi, 6)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_ratio: float | None = None,
    block_tokens: int = 200_000,
    seed: int = 1,
) -> DataFrame:
    """One row per input row with how often, and where, the mix has it.

    Columns: ``id_col``, ``source_col``, ``n_tokens``, ``exponent``, ``weight`` (of the source),
    ``budget_tokens`` (of the source), ``block_no``, ``copies``, and ``schedule``: for each copy
    an (epoch, block_key, doc_key). Sorted by these three, the copies of all documents are the
    mix: in each epoch the blocks come in another permutation and so do the rows of a block.

    ``budget_ratio`` is the size of the mix against all tokens; None takes the smallest mix in
    which no source has less than one whole pass, so nothing is left out. What remains of a
    source's budget after whole passes is spent block by block on the first rows of the
    block's permutation, to the nearest document.

    A null source is a source of its own; a null or empty text costs one token; very long ones count whole.
    Rows with equal or null ids get equal places; other ties of the 60-bit keys, one in 10^18 pairs, are
    broken by source, block and id. One source alone has weight 1. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), source_key(F.col(source_col)).alias("_s"), word_tokens(whole_text(text_col)).alias("_t")
    )
    rows = written(rows, "mix-rows")
    sums = rows.groupBy("_s").agg(F.sum("_t").alias("_all"), F.count(F.lit(1)).alias("_n"))
    total = sums.agg(F.sum("_all")).collect()[0][0] or 1
    totals = written(sums.select("_s", "_all", "_n", (F.col("_all") / F.lit(float(total))).alias("share")), "mix-totals")

    a = bisect_exponent(totals, target_entropy, max_repeats, budget_ratio)
    raised = F.pow("share", F.lit(a))
    norm, cover, n = totals.agg(F.sum(raised), F.max(F.col("share") / raised), F.count(F.lit(1))).collect()[0]
    budget = total * (budget_ratio if budget_ratio is not None else (cover or 1.0) * (norm or 1.0))
    plan = totals.select(
        "_s",
        "_all",
        "_n",
        (raised / F.lit(norm or 1.0)).alias("weight"),
        F.round(raised / F.lit(norm or 1.0) * F.lit(float(budget))).cast("long").alias("budget_tokens"),
        F.ceil(F.col("_all") / F.lit(float(block_tokens))).alias("_blocks"),
    )
    plan = plan.withColumns({"_full": F.floor(F.col("budget_tokens") / F.col("_all")), "_rest": F.expr("budget_tokens % _all")})
    placed = rows.join(F.broadcast(plan), "_s") if n <= BROADCAST_SOURCES else split_join(rows, written(plan, "mix-plan"), ["_s"], "_n")
    placed = placed.withColumn("block_no", hash60(F.lit(seed), F.lit("block"), "_id") % F.col("_blocks"))

    # Rows that may be in the last, partial pass need their place in their block; no others do.
    whole = placed.filter("_rest = 0").withColumn("_more", F.lit(0))
    block = W.partitionBy("_s", "block_no")
    order = block.orderBy(hash60(F.lit(seed), "_full", "_id"), "_id").rowsBetween(W.unboundedPreceding, 0)
    partial = placed.filter("_rest > 0").withColumns({"_before": F.sum("_t").over(order), "_in_block": F.sum("_t").over(block)})
    share = F.floor(F.col("_rest") * F.col("_in_block") / F.col("_all"))
    partial = partial.withColumn("_more", F.when(2 * F.col("_before") - F.col("_t") <= 2 * share, 1).otherwise(0)).drop("_before", "_in_block")

    out = whole.unionByName(partial).withColumn("copies", (F.col("_full") + F.col("_more")).cast("long"))
    place = lambda e: F.struct(
        e.cast("int").alias("epoch"),
        hash60(F.lit(seed), e, F.col("_s"), F.col("block_no")).alias("block_key"),
        hash60(F.lit(seed), e, F.col("_id")).alias("doc_key"),
    )
    none = F.array().cast(T.ArrayType(T.LongType()))
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(none)
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_s") != "", F.expr("substring(_s, 3)")).alias(source_col),
        F.col("_t").alias("n_tokens"),
        F.lit(a).alias("exponent"),
        "weight",
        "budget_tokens",
        "block_no",
        "copies",
        F.transform(epochs, place).alias("schedule"),
    )

"""Exact deduplication by progressive refinement, with DataFrame functions only.

Rows are grouped by length, then by length and prefix hash, then by full hash. The full text
is hashed only for rows whose length and prefix hash occur more than once (and for a few others, by
mistake of a bit table of fixed size). Texts are never shuffled: what moves is a length, an 8-byte prefix hash and a digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, maybe_in, split_join, whole_text, written


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    prefix_chars: int = 256,
) -> DataFrame:
    """One row per input row: ``id_col``, ``carry``, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal if identical after lower-casing A-Z; a null text is an empty one. The
    largest id of a group is kept. Repeated rows count in ``group_size``, and each row that
    has the kept id is ``kept`` (ids name documents). Rows without an id are kept only if
    their whole group has none; ``keep_id`` is then null. An empty table gives an empty
    result. Other columns of ``docs`` are ignored, whatever their names.
    """
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("_id"), *carried, whole_text(text_col).alias("_text"))
    kept_columns = ["_id", *(f"_c{i}" for i in range(len(carry)))]
    length = F.char_length("_text").alias("_n")
    prefix = F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))).alias("_p")

    # Level 1 and 2. Both counts come from one scan; rows of a key are summed before they move.
    counted = written(rows.select(length, prefix).groupBy("_n", "_p").agg(F.count(F.lit(1)).alias("_k")), "exact-counts")
    lengths = counted.groupBy("_n").agg(F.sum("_k").alias("_all")).filter("_all > 1").select("_n")
    keys = written(counted.join(lengths, "_n", "left_semi").filter("_k > 1").select("_n", "_p"), "exact-keys")

    # Level 3. The digest is taken for rows that may hit a key only: one bit for each key tells, of a table of fixed size.
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    marked = maybe_in(rows.select("*", length, prefix), [F.col("_n"), F.col("_p")], keys)
    full = written(marked.select(*kept_columns, F.when(F.col("_maybe"), digest).alias("_full")), "exact-full")

    several = full.filter("_full is not null")
    groups = written(several.groupBy("_full").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    alone = full.filter("_full is null").select(*kept_columns, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = split_join(several, groups, ["_full"], "group_size").select(*kept_columns, "keep_id", "group_size").unionByName(alone)
    return out.select(
        F.col("_id").alias(id_col),
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )

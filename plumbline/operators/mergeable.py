"""Measures of columns that are kept in a state and merge exactly, in any order and any grouping.

A sample is the ``SAMPLE_SIZE`` values of smallest row key: the smallest of a union are among the smallest of its parts, and a batch that
is taken twice changes nothing. Quantiles are KLL sketches: up to ``KLL_K`` values are kept as they are, beyond that a quantile's rank
is off by about 2.3 / KLL_K^0.9 of all values at most (99 %). A histogram has bins of width 2^e that begin at multiples of it; e is the smallest
for which all bins from the smallest to the largest value are ``MOST_BINS`` or fewer. When the range grows, the width doubles and each
two neighbouring bins become one, so it takes one scan, needs no bounds, and merging equals counting the whole again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.types import is_numeric
from plumbline.operators.columns import SAMPLE_SIZE, column, field_types, number

MOST_BINS = 64
KLL_K = 1024
#: A value's bin number has at most so many bits, so that doubles tell bins apart.
BITS = 40
#: No bin is narrower than 2 to this, which is the width of bins of nothing but zeros: other values make it grow.
LOWEST = -1074

SAMPLE = "array<struct<k:string,v:string>>"
HISTOGRAM = "struct<e:int,bins:array<struct<i:bigint,n:bigint>>>"


def row_key(df: DataFrame) -> Column:
    """A key of each row from all its columns; equal rows have equal keys."""
    return F.md5(F.to_json(F.struct(*map(column, df.columns)), {"ignoreNullFields": "false"}))


def smallest(rows: DataFrame, keys: list[str], size: int = SAMPLE_SIZE) -> DataFrame:
    """(keys, sample) from rows (keys, k, v): of each key the ``size`` of smallest k, in order. A task passes on as many of each key at most."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("k", "v"))).filter(F.col("_rank") <= size)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("sample"))


def column_samples(df: DataFrame, key: Column, columns: list[str], group: str | None = None, size: int = SAMPLE_SIZE) -> DataFrame:
    """(column_name, sample), for each value of ``group`` too: the values, nulls too, of the rows of smallest ``key``."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), column(c).cast("string").alias("v")) for c in columns))
    if group is None:
        first = df.select(key.cast("string").alias("k"), pairs.alias("p")).orderBy("k").limit(size).select("k", F.inline("p"))
        return smallest(first, ["column_name"], size)
    first = df.select(column(group).alias("batch_id"), key.cast("string").alias("k"), pairs.alias("p"))
    first = first.withColumn("_rank", F.row_number().over(W.partitionBy("batch_id").orderBy("k"))).filter(F.col("_rank") <= size)
    return smallest(first.select("batch_id", "k", F.inline("p")), ["batch_id", "column_name"], size)


def merged_samples(states: DataFrame, keys: list[str], size: int = SAMPLE_SIZE) -> DataFrame:
    return smallest(states.select(*keys, F.inline("sample")), keys, size)


def bin_numbers(x: np.ndarray, e: int) -> np.ndarray:
    """floor(x / 2^e); a negative value too small to be divided is still below zero."""
    at = np.floor(np.ldexp(x, -e))
    return np.where((x < 0) & (at == 0), -1, at).astype(np.int64)


class Bins:
    """A histogram of one column that grows: counts by bin number, at one width."""

    def __init__(self):
        self.e, self.counts = LOWEST, {}

    def add(self, x: np.ndarray) -> None:
        x = x[np.isfinite(x)]
        if not len(x):
            return
        most = float(np.abs(x).max())
        e = max(self.e, int(np.frexp(most)[1]) - BITS) if most else self.e
        ends = np.array([x.min(), x.max()])
        while True:
            lo, hi = bin_numbers(ends, e).tolist()
            lo, hi = min([lo, *(i >> min(e - self.e, 4096) for i in self.counts)]), max([hi, *(i >> min(e - self.e, 4096) for i in self.counts)])
            if hi - lo < MOST_BINS:
                break
            e += 1
        old, shift = self.counts, e - self.e
        self.e, self.counts = e, {}
        for i, n in old.items():
            self.counts[i >> shift] = self.counts.get(i >> shift, 0) + n
        bins, n = np.unique(bin_numbers(x, e), return_counts=True)
        for i, k in zip(bins.tolist(), n.tolist(), strict=True):
            self.counts[i] = self.counts.get(i, 0) + k


def least_widths(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least e for each pair of bounds, as ``Bins`` finds it for one."""
    most = np.maximum(np.abs(lo), np.abs(hi))
    e = np.where(most > 0, np.maximum(np.frexp(most)[1] - BITS, LOWEST), LOWEST).astype(np.int64)
    spread = hi / (2 * MOST_BINS) - lo / (2 * MOST_BINS)
    e = np.maximum(e, np.where(spread > 0, np.frexp(spread)[1] - 3, LOWEST))  # as many bins need to be wider than this
    while (many := np.flatnonzero(bin_numbers(hi, e) - bin_numbers(lo, e) >= MOST_BINS)).size:
        e[many] += 1
    return e


def codes_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    """A number for each row; rows with the same keys have the same."""
    code = np.zeros(len(t), np.int64)
    for k in keys:
        at = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (at.max(initial=0) + 1) + at, return_inverse=True)[1]
    return code


def counted(t: pa.Table, order: np.ndarray, starts: np.ndarray, e: np.ndarray, i: np.ndarray, n: np.ndarray, lo: np.ndarray) -> pa.Table:
    """Rows of the same group and bin made one. ``order`` has the rows by group, which begin at ``starts``; e and lo are of groups, i and n of ordered rows."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    cell = group * MOST_BINS + (i - lo[group])
    by = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.diff(cell[by], prepend=-1))
    row = by[first]
    columns = {"e": pa.array(e[group[row]], pa.int32()), "i": pa.array(i[row], pa.int64()), "n": pa.array(np.add.reduceat(n[by], first), pa.int64())}
    kept = t.select([c for c in t.column_names if c not in columns]).take(pa.array(order[row]))
    for name, column_ in columns.items():
        kept = kept.append_column(name, column_)
    return kept


def bins_of_values(t: pa.Table, keys: list[str], x: np.ndarray) -> pa.Table:
    """(keys, e, i, n) of the values x beside the rows of t: for each group the bins that ``Bins`` has after them."""
    at = np.flatnonzero(np.isfinite(x))
    code = codes_of(t, keys)[at]
    by = np.argsort(code, kind="stable")
    starts, order = np.flatnonzero(np.diff(code[by], prepend=-1)), at[by]
    if not len(order):
        return counted(t, order, starts, *[np.zeros(0, np.int64)] * 4)
    lo, hi = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)
    e = least_widths(lo, hi)
    i = bin_numbers(x[order], np.repeat(e, np.diff(np.append(starts, len(order)))))
    return counted(t, order, starts, e, i, np.ones(len(order), np.int64), bin_numbers(lo, e))


def few_bins(t: pa.Table, keys: list[str]) -> pa.Table:
    """Bins (keys, e, i, n) of any widths as those of one width for each group, ``MOST_BINS`` at most."""
    if not len(t):
        return t
    code = codes_of(t, keys)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sizes = np.diff(np.append(starts, len(order)))
    e, i, n = (t.column(c).to_numpy().astype(np.int64)[order] for c in ("e", "i", "n"))
    widest = np.maximum.reduceat(e, starts)
    i = i >> np.minimum(np.repeat(widest, sizes) - e, 63)
    lo, hi, by = np.minimum.reduceat(i, starts), np.maximum.reduceat(i, starts), np.zeros(len(starts), np.int64)
    while (many := np.flatnonzero((hi >> by) - (lo >> by) >= MOST_BINS)).size:
        by[many] += 1
    return counted(t, order, starts, widest + by, i >> np.repeat(by, sizes), n, lo >> by)


#: Rows of bins that a task holds; of more it gives out what it has and begins again.
HELD_BINS = 400_000


def held_bins(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Tables of bins put together as far as a task's memory goes."""
    held, n = [], 0
    for t in tables:
        held.append(t)
        n += len(t)
        if n >= HELD_BINS:
            held = [few_bins(pa.concat_tables(held), keys)]
            n = len(held[0])
            if n >= HELD_BINS // 2:
                yield from held[0].to_batches(max_chunksize=50_000)
                held, n = [], 0
    if held:
        yield from few_bins(pa.concat_tables(held), keys).to_batches(max_chunksize=50_000)


def binned(names: list[str], keys: list[str]):
    """Each task's bins of all columns; rows of all groups are counted together."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for k, name in enumerate(names):
                groups = pa.table([pa.array([name] * len(batch), pa.string()), *(batch.column(c) for c in keys)], ["column_name", *keys]).select([*keys, "column_name"])
                yield bins_of_values(groups, keys, batch.column(f"x{k}").to_numpy(zero_copy_only=False).astype(np.float64))

    return lambda batches: held_bins(tables(batches), [*keys, "column_name"])


def histogram_states(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """(column_name, histogram), for each value of ``group`` too, of numeric columns, from one scan. Infinite values are in no bin."""
    kinds = dict(field_types(df))
    names = [c for c in columns if is_numeric(kinds[c])]
    keys = [] if group is None else ["batch_id"]
    by = [] if group is None else [column(group).cast("string").alias("batch_id")]
    kind = "batch_id string, " if group is not None else ""
    parts = df.select(*by, *(number(c, kinds[c]).alias(f"x{k}") for k, c in enumerate(names))).mapInArrow(binned(names, keys), f"{kind}column_name string, e int, i bigint, n bigint")
    return merged_bins(parts, [*keys, "column_name"])


def merged_bins(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, histogram) from rows (keys, e, i, n) of any widths, of which each task has few of a key. They are shuffled once, by their keys."""
    shift = lambda i, by: F.call_function("shiftright", i, F.least(by, F.lit(63)).cast("int"))
    w = W.partitionBy(*keys)
    wide = parts.withColumn("_e", F.max("e").over(w))
    level = wide.groupBy(*keys, "_e", shift(F.col("i"), F.col("_e") - F.col("e")).alias("i")).agg(F.sum("n").alias("n"))
    # how often the width must double until all bins are few enough
    ends = level.withColumns({"_lo": F.min("i").over(w), "_hi": F.max("i").over(w)})
    doublings = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: shift(F.col("_hi"), s) - shift(F.col("_lo"), s) < MOST_BINS))
    few = ends.withColumn("_s", doublings).groupBy(*keys, (F.col("_e") + F.col("_s")).alias("e"), shift(F.col("i"), F.col("_s")).alias("i")).agg(F.sum("n").alias("n"))
    return few.groupBy(*keys, "e").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("bins")).select(*keys, F.struct("e", "bins").alias("histogram"))


def merged_histograms(states: DataFrame, keys: list[str]) -> DataFrame:
    bins = states.select(*keys, F.col("histogram.e").alias("e"), F.inline("histogram.bins"))
    reduced = lambda batches: held_bins((pa.Table.from_batches([b]) for b in batches), keys)
    return merged_bins(bins.mapInArrow(reduced, bins.schema), keys)


def bins_of(histogram: Column) -> Column:
    """A histogram's bins as structs of lo (inside), hi (outside) and count; empty ones are left out."""
    width = F.pow(F.lit(2.0), histogram["e"])
    return F.transform(histogram["bins"], lambda b: F.struct((b["i"] * width).alias("lo"), ((b["i"] + 1) * width).alias("hi"), b["n"].alias("count")))

"""Substring deduplication: seed on winnowed anchors, extend both ways, keep maximal repeats.

An anchor is a run of ``ANCHOR`` words. Of the anchors that begin in each window of ``length``
words the one of smallest hash is selected, so equal windows select equal anchors: every
repeat of ``length`` words holds an anchor that occurs twice. Documents are joined on their
anchors: the occurrences of one meet in a task, each with the words to its left and right. Each match is extended
both ways, word by word outwards, as far as the windows that selected the anchor reach. How far any partner follows is told
by hashes of the words taken so far, so pairs of occurrences are never listed. What reaches ``length`` words
is a repeat; overlapping ones from neighbouring anchors together are the maximal repeats.

An anchor of more than ``HOT_ANCHOR`` occurrences is too much for a task. Its windows are then matched by
128-bit hash in an aggregate that sums in each task first: the same extensions, each a row of its own.

Documents of the same words stand for one another: one of them is searched, and each copy is
itself a repeat of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BROADCAST_KEYS, WordHashes, arrow_texts, map_texts, maybe_in, mix, split_join, whole_text, window_hashes, written

LENGTH, ANCHOR = 35, 20
#: Documents of one anchor that meet in a task.
HOT_ANCHOR = 5_000


def words_of(text: str) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D: what bytes.split() gives."""
    return text.encode("utf-8", "surrogatepass").split()


def selected(h: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` words the place of its selected anchor; and all anchors' hashes."""
    a = window_hashes(h, anchor)
    span = length - anchor + 1
    if len(a) < span:
        return np.empty(0, np.int64), a
    return np.lib.stride_tricks.sliding_window_view(a, span).argmin(axis=1) + np.arange(len(a) - span + 1), a


def cover(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the runs from ``begins`` to ``ends``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def _anchors(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in arrow_texts(batches):
            same, out = [], []
            for text in texts:
                w = words_of(text)
                same.append(xxhash.xxh3_128_digest(b" ".join(w)))
                at, a = selected(hashes.array(w), length, anchor)
                x, n = np.unique(a[np.unique(at)], return_counts=True)
                out.append(np.repeat(x, np.minimum(n, 2)).view(np.int64))  # twice in its own document: listed twice
            sizes = np.cumsum([0, *map(len, out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*out, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(same, pa.binary()), lists], ["_key", "_same", "_anchors"])

    return run


def _occurrences(length: int, anchor: int):
    """Each place of a known anchor that a window has selected, with the words around it, outwards, and which windows these are."""
    reach = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in arrow_texts(batches):
            rows, anchors, places, masks, around = [], [], [], [], []
            for k, (text, seeds) in enumerate(zip(texts, batch.column("_seeds"), strict=True)):
                if not len(seeds.values):
                    continue
                h = hashes.array(words_of(text))
                at, a = selected(h, length, anchor)
                known = np.isin(a, seeds.values.to_numpy(zero_copy_only=False).view(np.uint64))
                s = np.flatnonzero(known[at])  # windows, each with its anchor's place at[s]
                p, which = np.unique(at[s], return_inverse=True)
                mask = np.zeros(len(p), np.int64)
                np.bitwise_or.at(mask, which, np.int64(1) << (at[s] - s))
                wide = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(reach, np.uint64)])
                steps = np.arange(reach)
                left, right = wide[p[:, None] + reach - 1 - steps], wide[p[:, None] + reach + anchor + steps]
                rows.append(np.full(len(p), k))
                anchors.append(a[p])
                places.append(p)
                masks.append(mask)
                around.append(np.concatenate([left, right], axis=1))
            join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind, copy=False)
            flat = join([x.ravel() for x in around], np.uint64)
            n = sum(map(len, rows))
            words = pa.Array.from_buffers(pa.binary(16 * reach), n, [None, pa.py_buffer(flat.tobytes())]) if reach else pa.array([b""] * n, pa.binary())
            columns = [pa.array(join(anchors, np.uint64).view(np.int64)), batch.column("_key").take(pa.array(join(rows, np.int64))), pa.array(join(places, np.int32)), pa.array(join(masks, np.int64)), words.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_a", "_key", "_at", "_mask", "_words"])

    return run


def _extended(length: int, anchor: int):
    """The repeats (begin, end) of ``length`` words or more around each occurrence; rows come sorted by their anchor."""
    reach = length - anchor

    def repeats(rows: pa.Table) -> pa.RecordBatch:
        a = rows.column("_a").to_numpy().view(np.uint64)
        mask, at = rows.column("_mask").to_numpy(), rows.column("_at").to_numpy().astype(np.int64)
        words = np.frombuffer(b"".join(rows.column("_words").to_pylist()), np.uint64).reshape(len(a), 2 * reach)
        so_far = [[mix(a)], [mix(a + np.uint64(1))]]  # hashes of the anchor and 0, 1, 2 ... words to its left and right
        for side in (0, 1):
            for k in range(reach):
                so_far[side].append(mix(so_far[side][-1] * np.uint64(0x9E3779B97F4A7C15) + words[:, side * reach + k]))
        matched = np.zeros((len(a), reach + 1), bool)
        for k in range(reach + 1):  # k words to the left and the rest to the right
            has = np.flatnonzero(mask >> k & 1)
            _, group, n = np.unique(mix(so_far[0][k][has] + mix(so_far[1][reach - k][has])), return_inverse=True, return_counts=True)
            matched[has[n[group] > 1], k] = True
        edge = np.diff(np.pad(matched.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, least), (_, past) = np.nonzero(edge == 1), np.nonzero(edge == -1)  # runs of windows from least to past - 1 words to the left
        keys = rows.column("_key").combine_chunks().take(pa.array(i))
        return pa.RecordBatch.from_arrays([keys, pa.array((at[i] - past + 1).astype(np.int32)), pa.array((at[i] - least + length).astype(np.int32))], ["_key", "_begin", "_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            a = rows.column("_a").to_numpy()
            whole = int(np.searchsorted(a, a[-1])) if len(a) else 0  # the last anchor may go on in the next batch
            if whole:
                yield repeats(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield repeats(held)

    return run


def _windows(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in arrow_texts(batches):
            rows, starts, one, two = [], [], [], []
            for k, (text, seeds) in enumerate(zip(texts, batch.column("_hot"), strict=True)):
                h = hashes.array(words_of(text))
                at, a = selected(h, length, anchor)
                known = np.isin(a, seeds.values.to_numpy(zero_copy_only=False).view(np.uint64))
                s = np.flatnonzero(known[at])
                rows.append(np.full(len(s), k))
                starts.append(s)
                one.append(window_hashes(h, length)[s])
                two.append(window_hashes(mix(h + np.uint64(1)), length)[s])
            join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind, copy=False)
            keys = batch.column("_key").take(pa.array(join(rows, np.int64)))
            columns = [keys, pa.array(join(starts, np.int32)), pa.array(join(one, np.uint64).view(np.int64)), pa.array(join(two, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_start", "_h1", "_h2"])

    return run


def _removal():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_texts(batches):
            kept, total, removed, spans = [], [], [], []
            for text, whole, runs in zip(texts, batch.column("_whole").to_pylist(), batch.column("_runs"), strict=True):
                w = words_of(text)
                total.append(len(w))
                gone = np.full(len(w), bool(whole))
                if not whole and runs.is_valid:
                    ends = runs.values
                    gone = cover(len(w), ends.field("_begin").to_numpy(), ends.field("_end").to_numpy())
                removed.append(int(gone.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append(edge.tolist())
                kept.append(b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(w))
            columns = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["_id", "n_words", "n_removed", "repeats", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``, ``repeats``, ``kept_text``.

    A word goes if any window of ``length`` words that covers it also begins anywhere else in
    the table, in the same document too. ``repeats`` has the removed runs as word numbers
    begin, end, begin, end, ...; ``kept_text`` is the other words joined by single spaces.
    Null and empty texts have no words; very long ones are searched whole. Texts under ``length`` words keep all of them. Rows are
    told apart by their text alone, so null or repeated ids are as good as any: a row that
    stands twice is a repeat of itself. An empty table gives an empty result.
    """
    if not 0 < anchor <= length:
        raise ValueError("anchor must be from 1 to length")
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).withColumn("_key", F.unhex(F.md5("_text")))
    kind = docs.schema[id_col].dataType.simpleString()
    found = map_texts(texts.select("_key", "_text"), _anchors(length, anchor), "_key binary, _same binary, _anchors array<bigint>")
    found = written(found.filter("size(_anchors) > 0"), "repeat-anchors")

    # one row for each sequence of words, with its anchors; where it has several rows all are copies
    first = found.groupBy("_same").agg(F.min(F.struct("_key", "_anchors")).alias("f"), F.count(F.lit(1)).alias("_n")).select("_same", "_n", "f.*")
    first = written(first, "repeat-first")
    copies = found.join(first.filter("_n > 1").select("_same"), "_same", "left_semi").select("_key").distinct()

    once = first.select("_key", F.explode("_anchors").alias("_a"))
    seeds = written(once.groupBy("_a").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1"), "repeat-known")
    known = split_join(once, seeds, ["_a"], "_k")
    hot = F.col("_k") > HOT_ANCHOR
    seeded = written(known.groupBy("_key").agg(F.collect_set(F.when(~hot, F.col("_a"))).alias("_seeds"), F.collect_set(F.when(hot, F.col("_a"))).alias("_hot")), "repeat-seeds")

    # texts without a known anchor stay where they are, and so do copies of a text but for one in each task
    searched = maybe_in(texts.select("_key", "_text"), [F.col("_key")], seeded.select("_key")).filter("_maybe").drop("_maybe")
    one_text = searched.groupBy("_key").agg(F.first("_text").alias("_text")).join(seeded, "_key")
    around = map_texts(one_text.select("_key", "_text", "_seeds"), _occurrences(length, anchor), "_a bigint, _key binary, _at int, _mask bigint, _words binary")
    found_runs = map_texts(around.repartition("_a").sortWithinPartitions("_a", "_key", "_at"), _extended(length, anchor), "_key binary, _begin int, _end int")
    runs = written(found_runs, "repeat-runs")
    if not seeds.filter(hot).isEmpty():
        windows = map_texts(one_text.filter("size(_hot) > 0").select("_key", "_text", "_hot"), _windows(length, anchor), "_key binary, _start int, _h1 bigint, _h2 bigint")
        windows = written(windows, "repeat-windows")
        twice = written(windows.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1"), "repeat-twice")
        runs = runs.unionByName(split_join(windows, twice, ["_h1", "_h2"], "_k").select("_key", F.col("_start").alias("_begin"), (F.col("_start") + length).alias("_end")))
    starts = runs.groupBy("_key").agg(F.collect_list(F.struct("_begin", "_end")).alias("_runs"))

    rows_of = written(found.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")), "repeat-rows")
    marks = starts.join(copies.withColumn("_whole", F.lit(True)), "_key", "full").join(rows_of, "_key")
    marks = written(marks.select("_key", "_rows", "_whole", "_runs"), "repeat-marks")
    # Only texts that lose words meet their marks. Rows of one text, if there are many, stay too: they are
    # copies, so that they lose all words is all there is to know.
    total, most = marks.agg(F.sum("_rows"), F.max("_rows")).collect()[0]
    limit = max(common.HOT_ROWS, (total or 0) // BROADCAST_KEYS)
    tried = maybe_in(texts, [F.col("_key")], marks.select("_key"))
    clean, maybe = tried.filter("not _maybe"), tried.filter("_maybe")
    no_runs = F.lit(None).cast(dict(marks.dtypes)["_runs"]).alias("_runs")
    parts = [clean.select("_id", "_text", F.lit(False).alias("_whole"), no_runs)]
    if (most or 0) > limit:
        large = F.broadcast(marks.filter(F.col("_rows") > limit).select("_key"))
        parts.append(maybe.join(large, "_key", "left_semi").select("_id", "_text", F.lit(True).alias("_whole"), no_runs))
        maybe = maybe.join(large, "_key", "left_anti")
    parts.append(maybe.join(marks.filter(F.col("_rows") <= limit), "_key", "left").select("_id", "_text", "_whole", "_runs"))
    marked = reduce(DataFrame.unionByName, parts)
    out = map_texts(marked, _removal(), f"_id {kind}, n_words bigint, n_removed bigint, repeats array<int>, kept_text string")
    return out.withColumnRenamed("_id", id_col)

"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as their lower-cased words joined by single spaces. Two strings within e
edits of each other share at least n - q + 1 - q e of the n - q + 1 q-grams of the shorter
one, and those lie on diagonals that differ by e at most. So q-grams shared with a benchmark
item are counted in overlapping bands of diagonals; only bands that reach the bound are
aligned, inside a band of that width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_texts, map_texts, whole_text, window_hashes, written

#: q-gram length, edits allowed per character, and characters of benchmark text in one broadcast block.
Q, EDIT_RATE, BLOCK_CHARS = 12, 0.06, 4_000_000
WORD = re.compile(r"\w+")
_BITS = 20
#: Places of q-grams in items that are looked at at once: what bounds a task's memory where many items share a q-gram.
ENTRIES = 1_000_000


def normalise(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def qgrams(text: str) -> np.ndarray:
    return window_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1), Q)


@dataclass
class Index:
    """One block of items: their sorted q-grams, where each stands, and a bit table to skip most lookups."""

    ids: list
    texts: list[str]
    grams: np.ndarray
    item: np.ndarray
    at: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    seen: np.ndarray
    short: list[tuple[int, re.Pattern]]


def edit_budget(n: int) -> int:
    """Edits allowed for an item of n characters: the rate's share, but no more than leave a q-gram shared."""
    return max(0, min(int(EDIT_RATE * n), (n - Q) // Q))


def build(items: list[tuple]) -> Index:
    texts = [t for _, t in items]
    each = [qgrams(t) for t in texts]
    grams = np.concatenate([*each, np.empty(0, np.uint64)])
    item = np.repeat(np.arange(len(items)), [len(x) for x in each]).astype(np.int64)
    at = np.concatenate([*(np.arange(len(x)) for x in each), np.empty(0, np.int64)]).astype(np.int64)
    order = np.argsort(grams, kind="stable")
    edits = np.array([edit_budget(len(t)) for t in texts], np.int64)
    least = np.array([len(t) - Q + 1 for t in texts], np.int64) - Q * edits
    seen = np.zeros(1 << _BITS, bool)
    seen[grams >> np.uint64(64 - _BITS)] = True
    short = [(k, re.compile(rf"(?<!\w){re.escape(t)}(?!\w)")) for k, t in enumerate(texts) if 0 < len(t) < Q]
    return Index([i for i, _ in items], texts, grams[order], item[order], at[order], edits, np.maximum(least, 1), seen, short)


def regions(index: Index, text: str) -> list[tuple[int, int, int]]:
    """(item, first diagonal, last diagonal) of the bands of diagonals that reach the bound of the q-gram lemma."""
    g = qgrams(text)
    where = np.flatnonzero(index.seen[g >> np.uint64(64 - _BITS)])
    if not len(where):
        return []
    g = g[where]
    left, right = np.searchsorted(index.grams, g, "left"), np.searchsorted(index.grams, g, "right")
    n = right - left
    counts: list[list[np.ndarray]] = [[], []]
    for part in slices(n):
        many = n[part]
        entry = np.repeat(left[part] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        item = index.item[entry]
        diagonal = np.repeat(where[part], many) - index.at[entry]
        width = 2 * index.edits[item] + 1  # bands overlap by half, so any run of edits + 1 diagonals lies in one of them
        for shift in (0, 1):
            band = (diagonal + shift * (index.edits[item] + 1)) // width
            counts[shift].append(summed(item, band, np.ones(len(item), np.int64)))
    found = []
    for shift in (0, 1):
        if not counts[shift]:
            continue
        item, band, count = summed(*np.concatenate(counts[shift], axis=1))
        for c in np.flatnonzero(count >= index.least[item]):
            k = int(item[c])
            w = 2 * int(index.edits[k]) + 1
            first = int(band[c]) * w - shift * (int(index.edits[k]) + 1)
            found.append((k, first, first + w - 1))
    return found


def slices(n: np.ndarray) -> Iterator[slice]:
    """Consecutive parts whose sums of ``n`` are at most ``ENTRIES``, or one q-gram."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        z = int(np.searchsorted(total, ENTRIES + (total[a - 1] if a else 0), "right"))
        z = max(z, a + 1)
        if total[z - 1] - (total[a - 1] if a else 0):
            yield slice(a, z)
        a = z


def summed(item: np.ndarray, band: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Items, bands and the sums of their counts, once each."""
    order = np.lexsort((band, item))
    i, b = item[order], band[order]
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), (i[1:] != i[:-1]) | (b[1:] != b[:-1])]))
    return np.array([i[cut], b[cut], np.add.reduceat(count[order], cut) if len(cut) else count[:0]])


def align(item: str, text: str, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of ``item`` in ``text`` on diagonals first..last widened by ``edits``, or None."""
    lo, n, m = first - edits, len(item), len(text)
    width = last - first + 1 + 2 * edits
    codes = np.full(n + width + 1, -1, np.int64)  # codes[k] is the character of text at lo + k
    a, b = max(lo, 0), min(lo + len(codes), m)
    if a >= b:
        return None
    codes[a - lo : b - lo] = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
    # cell j of row r ends before text position lo + r + j; outside the text no alignment may begin
    steps = np.arange(width)
    begin = lo + steps
    cost = np.where((begin >= 0) & (begin <= m), 0, 1 << 20)
    start, scale = begin.copy(), 1 << width.bit_length()
    for r, ch in enumerate(item):
        same = cost + (codes[r : r + width] != ord(ch))
        up = np.append(cost[1:] + 1, 1 << 20)  # a character of the item is missing from the text
        best = np.where(up < same, up, same)
        start = np.where(up < same, np.append(start[1:], 0), start)
        run = np.minimum.accumulate((best - steps) * scale + steps)  # characters of the text are extra
        source = run % scale
        cost = best[source] + steps - source
        start = start[source]
    j = int(np.argmin(cost))
    end = lo + n + j
    return (int(start[j]), min(end, m), int(cost[j])) if cost[j] <= edits and end <= m + edits else None


def search(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) in normalised text; of overlapping places of an item the one with fewest edits."""
    out: dict[int, list] = {}
    for k, first, last in regions(index, text):
        item, edits = index.texts[k], int(index.edits[k])
        exact = text.find(item, max(0, first), last + len(item))
        hit = (exact, exact + len(item), 0) if exact >= 0 else align(item, text, first, last, edits)
        if hit:
            out.setdefault(k, []).append(hit)
    for k, pattern in index.short:  # shorter than a q-gram: whole words that match exactly
        out.setdefault(k, []).extend((*m.span(), 0) for m in pattern.finditer(text))
    best = []
    for k, hits in out.items():
        for s, e, d in sorted(hits, key=lambda h: (h[2], h[0])):
            if all(s >= y or e <= x for _, x, y, _ in (b for b in best if b[0] == k)):
                best.append((k, s, e, d))
    return sorted(best)


def source_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that the normalised span covers, in whole words."""
    at, first, last, low = 0, None, 0, text.lower()
    if len(low) == len(text):
        text = low
    for m in WORD.finditer(text):  # if a character's lower case is longer, words are measured one by one
        n = len(m.group().lower())
        if at + n > start and first is None:
            first = m.start()
        if at < end:
            last = m.end()
        at += n + 1
        if at >= end:
            break
    return (first or 0), last


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row for each place of a benchmark item in a document.

    Columns: ``id_col``, ``item_col``, ``start``, ``end`` (code points of the document, in whole
    words) and ``edits`` (of the normalised texts). The benchmark is taken in blocks of at most
    ``block_chars`` characters, each broadcast and searched for in all documents; items shorter
    than a q-gram must match exactly, as whole words. An item is looked for as a whole: a document that quotes
    half of it is not found. Null, empty and wordless items and documents match nothing; very long ones are
    searched whole. Repeated items and documents are reported as often as they stand. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), whole_text(item_text_col).alias("_text")).filter("_text <> ''")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"_id {kind}, _item {item_kind}, start int, end int, edits int"
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    spark = docs.sparkSession
    found, block, held = [], [], 0

    def search_block(block: list[tuple]) -> DataFrame:
        index = spark.sparkContext.broadcast(build(block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for batch, got in arrow_texts(batches):
                rows: list[list] = [[], [], [], [], []]
                for n, text in enumerate(got):
                    for k, s, e, d in search(ix, normalise(text)):
                        for column, v in zip(rows, (n, ix.ids[k], *source_span(text, s, e), d), strict=True):
                            column.append(v)
                ids = batch.column("_id").take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows[1], item_type), *(pa.array(c, pa.int32()) for c in rows[2:])], ["_id", "_item", "start", "end", "edits"])

        return map_texts(texts, run, schema)

    for r in items.toLocalIterator():
        t = normalise(r["_text"])
        if not t:
            continue
        if block and held + len(t) > block_chars:
            found.append(written(search_block(block), "leaks"))
            block, held = [], 0
        block.append((r["_item"], t))
        held += len(t)
    if block:
        found.append(search_block(block) if not found else written(search_block(block), "leaks"))
    if not found:
        found = [spark.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"_id": id_col, "_item": item_col})

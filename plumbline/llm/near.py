"""Near-duplicate classes by Order MinHash, verified by banded alignment of words.

A document is the sequence of its lower-cased words. Two are similar if at most a fifth of the
longer one's words must be inserted, deleted or replaced to make one the other: edit
similarity, 0.8 or more. That makes a link; classes are the connected components of the links.

An Order MinHash sample is the ``SAMPLED`` three-word k-mers of smallest hash, each labelled with
how often it has occurred before, in text order; so it tells rearranged texts apart. Each of
the ``BANDS`` samples is a band, and documents that agree in a band share a bucket. If a fifth of the
words are replaced at random, 0.35 of the k-mers of two texts are common, so they share a
band with a probability of 0.98; with a tenth it is over 0.9999.

Texts with the same words are one node from the start. Then, of each bucket:

1. Every member is compared with the pivot, the member whose id has the smallest hash. So a group of
   copies costs as many comparisons as it has members.
2. A bucket that still holds different classes has those compared with each other, in one task, if these are
   no more pairs than ``GROUP`` members have. A larger one is split by length first: similar texts are of one of two
   neighbouring length classes.
3. The members of what is larger even then are unsettled: texts that share a passage, not the rest. Among them
   an exact index takes the place of the bands. Two similar texts share 0.8 of the words of the longer
   one, counted with repeats; so in any order of all words they share one of their first 0.2 n + 1.
   Rare words come first, by a count sketch of fixed size. Words that no other unsettled text has
   link nothing, and the buckets of the others are treated as in 1 and 2.
4. What is still too large and mixed then, texts that share even rare words with many others but are not
   like them, is compared in blocks of bounded size: no task holds more than two blocks.

No text is aligned with another before the word counts of both, 256 bytes, say that they can be similar, and nothing
lists pairs but those with pivots. The size of a bucket decides how its members are compared, not whether.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, WordHashes, arrow_texts, map_texts, mix, only_ids, split_join, whole_text, window_hashes, written

KMER, SIMILARITY = 3, 0.8
BANDS, SAMPLED, GROUP, BLOCK = 32, 2, 2048, 512
MEMBERS = 2 * GROUP
#: Slots of the word counts of a text, and counts that are told apart in products.
COUNTS, UNARY = 256, 4
#: Members that meet one pivot in a task.
CHUNK = 256
#: Slots of the count sketch of words.
SLOTS = 1 << 20
WORD = re.compile(r"\w+")
_ODD = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-cased words; a text of signs only falls back to its space-separated parts."""
    return WORD.findall(text.lower()) or text.split()


def labelled(x: np.ndarray) -> np.ndarray:
    """The hashes ``x``, each unlike all before it: repeats carry their count."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    new = np.empty(len(y), bool)
    new[:1] = True
    new[1:] = y[1:] != y[:-1]
    if new.all():
        return x
    start = np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))
    label = np.empty(len(x), np.uint64)
    label[order] = (np.arange(len(y)) - start).astype(np.uint64)
    return np.where(label > 0, mix(x + label * np.uint64(0x9E3779B97F4A7C15)), x)


def kmers(h: np.ndarray) -> np.ndarray:
    """Labelled k-mers of the words ``h``; fewer words than that are one k-mer."""
    if 0 < len(h) < KMER:
        h = np.concatenate([h, np.zeros(KMER - len(h), np.uint64)])
    return labelled(window_hashes(h, KMER))


def order_minhash(x: np.ndarray) -> list[int]:
    """One 64-bit key per band: its smallest ``SAMPLED`` k-mers, in text order."""
    n = min(SAMPLED, len(x))
    out = np.empty(BANDS, np.uint64)
    for s in range(0, BANDS, 8):  # eight at a time: memory stays at 64 bytes a k-mer
        h = x[None, :] * _ODD[s : s + 8, None]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.empty((8, n), np.int64)
        for k in range(n):
            at[:, k] = h.argmin(axis=1)
            h[np.arange(8), at[:, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        key = np.arange(s, s + 8, dtype=np.uint64)
        for k in range(n):
            key = mix(key * np.uint64(31) + x[at[:, k]])
        out[s : s + 8] = key
    return out.view(np.int64).tolist()


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch, texts in arrow_texts(batches):
        same, bands = [], []
        for text in texts:
            words = words_of(text)
            same.append(xxhash.xxh3_128_digest("\x1f".join(words)))
            bands.append(order_minhash(kmers(hashes.array(words))) if words else [])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["_id", "_same", "_bands"])


def counts_of(h: np.ndarray) -> np.ndarray:
    """Words by slot, up to 255 each: differences between two texts are never overstated."""
    slots = (mix(h) >> np.uint64(56)).astype(np.int64) % COUNTS
    return np.minimum(np.bincount(slots, minlength=COUNTS), 255).astype(np.uint8)


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch, texts in arrow_texts(batches):
        x = [hashes.array(words_of(t)) for t in texts]
        sizes = np.cumsum([0, *map(len, x)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*x, np.empty(0, np.uint64)]).view(np.int64)))
        counts = pa.array([counts_of(h).tobytes() for h in x], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), lists, pa.array(list(map(len, x)), pa.int32()), counts], ["_id", "_x", "_w", "_c"])


def counted(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16)


def can_be_similar(a: np.ndarray, n: int | np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether texts of n and m words can be similar by their word counts ``a`` and ``b``: of the longer one, few enough words have no partner."""
    missing = np.maximum(a - b, 0).sum(axis=1)
    other = missing - (a.sum(axis=-1) - b.sum(axis=-1))
    return np.where(n >= m, missing, other) <= (1 - SIMILARITY) * np.maximum(n, m) + 1e-9


def banded_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is ``most`` or less, else None.

    Only cells within ``most`` of the main diagonal are looked at. A column of that band is kept as the bits
    of two integers, where its cells rise and where they fall, and all of it advances by a few
    integer operations for each word of ``b`` (bit-parallel alignment).
    """
    if len(a) > len(b):
        a, b = b, a
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while a and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    if m - n > most:
        return None
    if not n:
        return m
    d = min(most, m)
    full = (1 << (2 * d + 1)) - 1
    low = (1 << d) - 1
    up, down = full ^ low, 0  # rows above the first have no rise
    known: dict = {}  # word: (row of bit 0, bits of the rows where it stands)

    def put(row: int) -> None:
        base, bits = known.get(a[row], (row, 0))
        first = max(base, row - 2 * d)
        known[a[row]] = first, (bits >> (first - base)) | (1 << (row - first))

    for row in range(min(d, n)):
        put(row)
    cost = min(d, n)
    for j, word in enumerate(b, 1):
        if j + d <= n:
            put(j + d - 1)
        same = 0
        if word in known:
            base, bits = known[word]
            shift = j - d - 1 - base
            same = (bits >> shift if shift >= 0 else bits << -shift) & full
        flat = (((same & up) + up) ^ up) | same | down  # no cost along the diagonal
        flat &= full
        right_up = down | (full & ~(flat | up))
        right_down = up & flat
        if j + d <= n:
            cost += not flat >> (2 * d)
        else:
            k = n - j + d
            cost += (right_up >> k & 1) - (right_down >> k & 1)
        flat >>= 1
        up, down = right_down | (full & ~(flat | right_up)), flat & right_up
    return cost if cost <= most else None


def similar(a: list, b: list, counts: Counter | None = None) -> bool:
    """Whether the edit similarity of two word lists is ``SIMILARITY`` or more; ``counts`` are those of the words of ``a``."""
    longest = max(len(a), len(b))
    most = int((1 - SIMILARITY) * longest + 1e-9)
    if not min(len(a), len(b)) or longest - min(len(a), len(b)) > most:
        return False
    left = dict(counts if counts is not None else Counter(a))
    missing = len(b)
    for w in b:
        n = left.get(w, 0)
        if n:
            left[w] = n - 1
            missing -= 1
    least = longest - len(b) + missing  # words of the longer text without a partner
    if least > most:
        return False
    within = max(32, 2 * least)
    while within < most:  # most similar texts are much closer than they must be
        if banded_distance(a, b, within) is not None:
            return True
        within *= 4
    return banded_distance(a, b, most) is not None


def words_can_be(cp: pa.Array, n: np.ndarray, c: pa.Array, m: np.ndarray) -> np.ndarray:
    return can_be_similar(counted(cp), n, counted(c), m)


def word_pairs(roots: list, n: np.ndarray, c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pairs_in_group(roots, n, counted(c))


class Likeness(NamedTuple):
    """How texts are compared: exactly, as lists of symbols; and by sketches (_c), which never rule out what is alike."""

    alike: Callable = similar
    can_be: Callable = words_can_be  # of rows: sketch and size of both sides
    pairs: Callable = word_pairs  # of a group: places of pairs of different classes that can be alike


WORDS = Likeness()


def listed(steps: Steps, ids: DataFrame, few: DataFrame, lists: Callable | None) -> DataFrame:
    """``few`` with symbols, for those of ``ids`` at least."""
    return lists(steps.written(ids.select("_id").distinct(), "compared")) if lists else few


def verify(batches: Iterator[pa.RecordBatch], alike: Callable = similar) -> Iterator[pa.RecordBatch]:
    """Each pivot's row is followed by those to compare with it."""
    pivot = None
    for batch in batches:
        heads, kept = batch.column("_x").is_null().to_pylist(), []
        for k, head in enumerate(heads):
            if head:
                words = batch.column("_px")[k].values.to_pylist()
                pivot = words, Counter(words)
            elif alike(pivot[0], batch.column("_x")[k].values.to_pylist(), pivot[1]):
                kept.append(k)
        kept = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("_p").take(kept), batch.column("_id").take(kept)], ["_a", "_b"])


def plausible(batches: Iterator[pa.RecordBatch], likeness: Likeness = WORDS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = batch.column("_wp").to_numpy(), batch.column("_w").to_numpy()
        kept = pa.array(np.flatnonzero(likeness.can_be(batch.column("_cp"), n, batch.column("_c"), m)))
        yield pa.RecordBatch.from_arrays([batch.column("_p").take(kept), batch.column("_id").take(kept)], ["_p", "_id"])


def to_pivots(steps: Steps, buckets: DataFrame, few: DataFrame, likeness: Likeness = WORDS) -> DataFrame:
    """(_p, _id): members of ``buckets`` (_key, _id, _p) that can be similar to their bucket's pivot."""
    kind = few.schema["_id"].dataType.simpleString()
    pairs = steps.written(buckets.filter("_id <> _p").select("_p", "_id").distinct(), "star")
    sizes = pairs.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).join(few.select(F.col("_id").alias("_p"), F.col("_w").alias("_wp"), F.col("_c").alias("_cp")), "_p")
    both = split_join(pairs, steps.written(sizes, "pivots"), ["_p"], "_n").join(few.select("_id", "_w", "_c"), "_id")
    return map_texts(both.select("_p", "_id", "_wp", "_w", "_cp", "_c"), partial(plausible, likeness=likeness), f"_p {kind}, _id {kind}")


def links(steps: Steps, pairs: DataFrame, few: DataFrame, alike: Callable = similar) -> DataFrame:
    """Of the candidate ``pairs`` (_p, _id), those that are ``alike``; a pivot's text moves once for ``CHUNK`` of its pairs."""
    kind = few.schema["_id"].dataType.simpleString()
    pairs = steps.written(pairs, "pairs")
    sizes = steps.written(pairs.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    dealt = split_join(pairs, sizes, ["_p"], "_n").select("_p", "_id", F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / CHUNK)).alias("_c"))
    chunks = sizes.select("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / CHUNK) - 1)).alias("_c"))
    none = F.lit(None).cast("array<bigint>")
    heads = chunks.join(few.select(F.col("_id").alias("_p"), F.col("_x").alias("_px")), "_p").select("_p", "_c", F.lit(None).cast(kind).alias("_id"), "_px", none.alias("_x"))
    tails = dealt.join(few.select("_id", "_x"), "_id").select("_p", "_c", "_id", none.alias("_px"), "_x")
    both = heads.unionByName(tails).repartition("_p", "_c").sortWithinPartitions("_p", "_c", F.col("_x").isNotNull(), "_id")
    return steps.written(map_texts(both, partial(verify, alike=alike), f"_a {kind}, _b {kind}"), "links")


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """(_id, _root) for each node of the written ``edges`` (_a, _b); the root is the smallest id of its component.

    First every node hangs on the smallest of those that it is linked to as ``_b``; with links to pivots these are few,
    one for each band, and what is left is a small graph of pivots, so a pivot of very many members is no large node of it.
    Then large-star and small-star steps alternate: every node's larger neighbours, then its smaller
    ones, are hung on its smallest neighbour, until the edges are stars. One shuffle serves each step.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.filter("u <> v").repartition("u").distinct()

    def hung(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    own = steps.written(edges.filter("_a <> _b").groupBy(F.col("_b").alias("_id")).agg(F.least(F.min("_a"), "_id").alias("_low"), F.collect_set("_a").alias("_up")), "own")
    up = own.select(F.explode(F.concat("_up", F.array("_id"))).alias("_x"), "_low").filter("_x <> _low")
    e = up.select(F.greatest("_x", "_low").alias("u"), F.least("_x", "_low").alias("v"))
    # nodes that are no pivot have one link now, to their smallest neighbour, and wait for its root
    inner = own.select(F.explode("_up").alias("_id")).distinct()
    waits = own.select("_id", "_low").filter("_id <> _low").join(inner, "_id", "left_anti")
    e = steps.written(dealt(e.join(waits.select(F.col("_id").alias("u"), F.col("_low").alias("v")), ["u", "v"], "left_anti")), "edges")
    mark = None
    while True:
        both = dealt(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.filter("v > u").join(hung(both).withColumn("m", F.least("u", "m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = dealt(large)
        least = hung(large)
        small = large.join(least, "u").select("v", "m").filter("v <> m").toDF("u", "v").unionByName(least.toDF("u", "v"))
        e = steps.written(dealt(small), "edges")
        last, mark = mark, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if mark == last:
            break
    roots = e.toDF("_id", "_root").unionByName(e.select(F.col("v").alias("_id"), F.col("v").alias("_root")).distinct())
    roots = steps.written(roots, "inner-roots")
    rest = waits.join(roots.toDF("_low", "_root"), "_low", "left").select("_id", F.coalesce("_root", "_low").alias("_root"))
    alone = waits.select(F.col("_low").alias("_id")).distinct().join(roots, "_id", "left_anti").select("_id", F.col("_id").alias("_root"))
    return steps.written(roots.unionByName(rest).unionByName(alone), "roots")


def joined_components(steps: Steps, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after more links: only the components that the new links touch are gone over again."""
    if edges.isEmpty():
        return roots
    met = edges
    for c in ("_a", "_b"):
        met = met.join(roots.select(F.col("_id").alias(c), F.col("_root").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    more = components(steps, steps.written(met.filter("_a <> _b"), "met"))
    moved = roots.join(more.toDF("_root", "_new"), "_root", "left").select("_id", F.coalesce("_new", "_root").alias("_root"))
    return steps.written(moved.unionByName(more.join(roots.select("_id"), "_id", "left_anti")), "roots")


def with_class(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))


def with_pivot(steps: Steps, rows: DataFrame) -> DataFrame:
    """``rows`` (_key, _id) of buckets of two or more, with the bucket's size ``_n`` and pivot ``_p``."""
    pivot = F.min(F.struct(F.xxhash64("_id"), "_id"))["_id"]
    sizes = steps.written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), pivot.alias("_p")).filter("_n > 1"), "sizes")
    return steps.written(split_join(rows, sizes, ["_key"], "_n"), "buckets")


def mixed(steps: Steps, at: DataFrame) -> DataFrame:
    """The members of the buckets of the written ``at`` (_key, _id, _p, _root) that hold different classes, with ``_small``: whether a task can compare all of them."""
    of_class = at.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("_c"))
    several = of_class.groupBy("_key").agg(F.sum("_c").alias("_m"), F.count(F.lit(1)).alias("_k"), F.sum(F.col("_c") * F.col("_c")).alias("_same")).filter("_k > 1")
    small = (F.col("_m") <= MEMBERS) & (F.col("_m") * F.col("_m") - F.col("_same") <= GROUP * GROUP)
    several = steps.written(several.select("_key", "_m", small.alias("_small")), "mixed-keys")
    return steps.written(split_join(at, several, ["_key"], "_m").drop("_m"), "mixed")


def pairs_in_group(roots: list, n: np.ndarray, counts: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different classes that can be similar, as two arrays of places.

    The words two texts share are at most the sum of the lesser counts. With counts of up to ``UNARY`` written
    as that many ones, it is a product of matrices, and what is beyond adds the lesser of both rests. Members go by
    class, the largest first, so the partners of each are all those after its class.
    """
    _, root, size = np.unique(np.array(list(map(str, roots))), return_inverse=True, return_counts=True)
    order = np.lexsort((root, -size[root]))
    root, n, counts = root[order], n[order], counts[order]
    last = np.flatnonzero(np.append(root[1:] != root[:-1], True)) + 1  # where each class ends
    after = last[np.searchsorted(last, np.arange(len(root)), "right")]
    ones = (counts[:, None, :] > np.arange(UNARY)[None, :, None]).reshape(len(root), -1).astype(np.float32)
    rest = n - ones.sum(axis=1)
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for a in range(0, len(root), rows):
        part, low = slice(a, a + rows), after[a]
        if low >= len(root):
            break
        shared = ones[part] @ ones[low:].T + np.minimum(rest[part, None], rest[None, low:])
        can = shared >= SIMILARITY * np.maximum(n[part, None], n[None, low:]) - 0.01
        i, j = np.nonzero(can & (np.arange(low, len(root))[None, :] >= after[part, None]))
        found[0].append(i + a)
        found[1].append(j + low)
    left, right = map(np.concatenate, found)
    return order[left], order[right]


def runs_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that each hold whole runs of rows with one ``_key``; rows come sorted by it, and a run may go over into the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        key = rows.column("_key").to_numpy()
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
        if whole:
            yield rows.slice(0, whole).combine_chunks()
        held = rows.slice(whole)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_ends(key: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]


def sifted(batches: Iterator[pa.RecordBatch], likeness: Likeness) -> Iterator[pa.RecordBatch]:
    """Of each group the members that can be alike to one of another class."""
    for rows in runs_by_key(batches):
        roots, n, sketches = rows.column("_root").to_pylist(), rows.column("_w").to_numpy(), rows.column("_c").combine_chunks()
        cut, kept = group_ends(rows.column("_key").to_numpy()), [np.empty(0, np.int64)]
        for a, z in zip(cut, cut[1:]):
            left, right = likeness.pairs(roots[a:z], n[a:z], sketches.slice(a, z - a))
            kept.append(a + np.unique(np.concatenate([left, right])))
        at = pa.array(np.concatenate(kept).astype(np.int64))
        yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(at) for c in ("_key", "_id", "_root")], ["_key", "_id", "_root"])


def in_groups(batches: Iterator[pa.RecordBatch], likeness: Likeness = WORDS) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows with one ``_key``; rows come sorted by it, so a group may go over into the next batch.

    Two members may share several groups; a hash of both chooses in which of these they are aligned.
    """

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        key, ids = rows.column("_key").to_numpy(), rows.column("_id").to_pylist()
        roots, n, sketches = rows.column("_root").to_pylist(), rows.column("_w").to_numpy(), rows.column("_c").combine_chunks()
        keys, texts = rows.column("_keys").combine_chunks(), rows.column("_x").combine_chunks()
        cut = group_ends(key)
        found: list[list[int]] = [[], []]
        for a, z in zip(cut, cut[1:]):
            left, right = likeness.pairs(roots[a:z], n[a:z], sketches.slice(a, z - a))
            groups, words, here, now = {}, {}, int(key[a]), None
            for i, j in zip((left + a).tolist(), (right + a).tolist(), strict=True):
                for k in (i, j):
                    if k not in groups:
                        groups[k] = set(keys[k].values.to_pylist())
                pair = f"{min(ids[i], ids[j])}:{max(ids[i], ids[j])}"
                if here != min(groups[i] & groups[j], key=lambda g: xxhash.xxh3_64_intdigest(f"{g}:{pair}")):  # noqa: B023
                    continue
                for k in (i, j):
                    if k not in words:
                        words[k] = texts[k].values.to_pylist()
                if now != i:
                    now, bag = i, Counter(words[i])
                if likeness.alike(words[i], words[j], bag):
                    found[0].append(i)
                    found[1].append(j)
        column = rows.column("_id").combine_chunks()
        return pa.RecordBatch.from_arrays([column.take(pa.array(side, pa.int64())) for side in found], ["_a", "_b"])

    yield from map(links_of, runs_by_key(batches))


def between_classes(steps: Steps, rows: DataFrame, few: DataFrame, likeness: Likeness = WORDS, lists: Callable | None = None) -> DataFrame:
    """Links (_a, _b) between different classes within the small mixed buckets ``rows``, whose pivots have been compared. Only links are listed."""
    kind = few.schema["_id"].dataType.simpleString()
    members = steps.written(rows.filter(~F.col("_id").eqNullSafe(F.col("_p"))).select("_key", "_id", "_root"), "grouped")
    if lists:
        sketched = members.join(few.select("_id", "_w", "_c"), "_id").repartition("_key").sortWithinPartitions("_key", "_id")
        members = steps.written(map_texts(sketched.select("_key", "_id", "_root", "_w", "_c"), partial(sifted, likeness=likeness), f"_key bigint, _id {kind}, _root {kind}"), "sifted")
    own = members.groupBy("_id").agg(F.collect_set("_key").alias("_keys")).join(listed(steps, members, few, lists), "_id")  # a bucket for each band, two if split by length
    whole = members.join(own, "_id").repartition("_key").sortWithinPartitions("_key", "_id")
    return steps.written(map_texts(whole.select("_key", "_id", "_root", "_w", "_c", "_keys", "_x"), partial(in_groups, likeness=likeness), f"_a {kind}, _b {kind}"), "between")


def by_length(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` (_key, _id, _root) of large buckets, each in two of the buckets that these are split in by length."""
    step = F.floor(F.log(F.col("_w").cast("double")) / float(np.log(1 / SIMILARITY)) + 1e-9)
    sized = rows.select("_key", "_id", "_root").join(few.select("_id", "_w"), "_id")
    return sized.select(F.explode(F.array(step, step + 1)).alias("_step"), "_key", "_id", "_root").select(F.xxhash64("_key", "_step").alias("_key"), "_id", "_root")


def slots_of(words: np.ndarray) -> np.ndarray:
    return (mix(words ^ np.uint64(0x5BF03635)) >> np.uint64(40)).astype(np.int64) % SLOTS


def sketch_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for x in batch.column("_x"):
            np.add.at(seen, slots_of(labelled(x.values.to_numpy().view(np.uint64))), 1)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["_slot", "_n"])


def rare_words(steps: Steps, rows: DataFrame, few: DataFrame) -> DataFrame:
    """(_key, _id): of each text of n words the rarest 0.2 n + 1, without those that certainly no other of these texts has."""
    lists = steps.written(only_ids(few.select("_id", "_x"), "_id", steps.written(rows.select("_id").distinct(), "unsettled")), "unsettled-lists")
    # one row for each slot and task at most; the sums are at most 8 MB, whatever the input
    sums = lists.mapInArrow(sketch_words, "_slot int, _n bigint").groupBy("_slot").agg(F.sum("_n").alias("_n"))
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in sums.collect():
        counts[slot] = n
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for k, x in enumerate(batch.column("_x")):
                w = labelled(x.values.to_numpy().view(np.uint64))
                n = shared.value[slots_of(w)]
                rank = np.lexsort((w, n))[: len(w) - int(np.ceil(SIMILARITY * len(w) - 1e-9)) + 1]
                rank = rank[n[rank] > 1]
                at.append(np.full(len(rank), k))
                keys.append(w[rank].view(np.int64))
            ids = batch.column("_id").take(pa.array(np.concatenate([*at, np.empty(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.int64)])), ids], ["_key", "_id"])

    kind = few.schema["_id"].dataType.simpleString()
    return map_texts(lists, run, f"_key bigint, _id {kind}")


def block_links(steps: Steps, rows: DataFrame, few: DataFrame, alike: Callable = similar) -> DataFrame:
    """Links between different classes within the buckets of ``rows`` (_key, _id, _root), found block by block.

    Buckets that overlap are one cluster. It is dealt to hashed blocks of about ``BLOCK`` members;
    two blocks meet in a task.
    """
    least = rows.groupBy("_key").agg(F.min("_id").alias("_b"), F.count(F.lit(1)).alias("_k"))
    met = split_join(rows.select("_key", "_id"), steps.written(least, "least"), ["_key"], "_k").select(F.col("_id").alias("_a"), "_b").distinct()
    own = components(steps, steps.written(met, "met"))
    members = steps.written(rows.select("_id", "_root").distinct().join(own.toDF("_id", "_key"), "_id"), "members")
    sizes = steps.written(members.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")), "clusters")
    n = F.ceil(F.col("_m") / BLOCK).cast("int")
    dealt = split_join(members, sizes, ["_key"], "_m").join(few.select("_id", "_x"), "_id")
    dealt = dealt.select("_key", "_id", "_root", "_x", F.pmod(F.xxhash64("_id"), n).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    dealt = dealt.select("_key", F.least("_b", "k").alias("i"), F.greatest("_b", "k").alias("j"), "_b", "_id", "_root", "_x")
    kind = few.schema["_id"].dataType.simpleString()
    return steps.written(dealt.groupBy("_key", "i", "j").applyInArrow(lambda rows: links_in_block(rows, alike), f"_a {kind}, _b {kind}"), "block-links")


def shared_counts(x: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many symbols each two of the sequences share; a sequence has a symbol once. Columns go by in bounded slices."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    _, at, n = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
    kept = np.cumsum(n > 1) - 1
    row, column = row[n[at] > 1], kept[at][n[at] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(x), len(x)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (c, c + columns))
        has = np.zeros((len(x), columns), np.float32)
        has[row[a:b], column[a:b] - c] = 1
        shared += has @ has.T
    return shared


def links_in_block(rows: pa.Table, alike: Callable = similar) -> pa.Table:
    ids, roots, block = (rows.column(c).to_pylist() for c in ("_id", "_root", "_b"))
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    x = [v.values.to_numpy().view(np.uint64) for v in rows.column("_x")]
    n = np.array([len(v) for v in x], np.float32)
    enough = shared_counts([labelled(v) for v in x]) >= SIMILARITY * np.maximum(n[:, None], n[None, :]) - 0.01
    likely = np.triu(enough, 1)
    same = np.unique(np.array([str(r) for r in roots]), return_inverse=True)[1]
    side = np.array(block)
    likely &= same[:, None] != same[None, :]
    if i != j:
        likely &= side[:, None] != side[None, :]
    found = [(p, q) for p, q in zip(*(k.tolist() for k in np.nonzero(likely)), strict=True) if alike(x[p].tolist(), x[q].tolist(), None)]
    kind = rows.schema.field("_id").type
    return pa.table({"_a": pa.array([min(ids[p], ids[q]) for p, q in found], kind), "_b": pa.array([max(ids[p], ids[q]) for p, q in found], kind)})


def classes(steps: Steps, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(_id, _root) for the ``nodes`` (_id, _bands) that are linked with any other."""
    bands = nodes.select(F.explode("_bands").alias("_key"), "_id")
    buckets = with_pivot(steps, bands)
    candidates = steps.written(buckets.select("_id").distinct(), "candidates")
    kind = nodes.schema["_id"].dataType.simpleString()
    few = steps.written(map_texts(only_ids(texts, "_id", candidates), word_lists, f"_id {kind}, _x array<bigint>, _w int, _c binary"), "lists")
    few = steps.written(few.dropDuplicates(["_id"]), "lists-once") if few.count() > candidates.count() else few  # repeated ids
    return linked(steps, buckets, few)


def linked(steps: Steps, buckets: DataFrame, few: DataFrame, likeness: Likeness = WORDS, lists: Callable | None = None) -> DataFrame:
    """(_id, _root) for all of the written ``buckets`` (_key, _id, _n, _p) whose members are to be compared by ``likeness``, which implies
    that both share 0.8 of the longer one's symbols. ``few`` has their symbols: _id, _x, _w (how many), _c (a sketch). With ``lists``, which gives
    these rows for written ids, ``few`` has no _x, and groups are sifted by sketches before anything is listed."""
    kind = few.schema["_id"].dataType.simpleString()

    def settled(buckets: DataFrame, roots: DataFrame | None, more: list[DataFrame]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
        """Steps 1 and 2 on ``buckets``: the roots with ``more`` links and those to pivots, the mixed buckets that are too large, the links of the others."""
        candidates = to_pivots(steps, buckets, few, likeness)
        candidates = steps.written(candidates, "candidates") if lists else candidates
        pivot_links = links(steps, candidates, listed(steps, candidates.select("_id").union(candidates.select("_p")), few, lists), likeness.alike)
        roots = components(steps, pivot_links) if roots is None else joined_components(steps, roots, reduce(DataFrame.unionByName, more, pivot_links))
        rest = mixed(steps, steps.written(with_class(buckets.select("_key", "_id", "_p"), roots), "classes"))
        groups, large = rest.filter("_small"), rest.filter("not _small")
        if not large.isEmpty():
            split = mixed(steps, steps.written(by_length(large, few).withColumn("_p", F.lit(None).cast(kind)), "by-length"))  # any two may be of different pivots
            groups, large = groups.unionByName(split.filter("_small")), split.filter("not _small")
        return roots, large, [between_classes(steps, groups, few, likeness, lists)]

    roots, large, more = settled(buckets, None, [])
    if not large.isEmpty():
        roots, large, more = settled(with_pivot(steps, steps.written(rare_words(steps, large, listed(steps, large, few, lists)), "rare")), roots, more)
        if not large.isEmpty():
            more.append(block_links(steps, large.select("_key", "_id", "_root"), listed(steps, large, few, lists), likeness.alike))
    return joined_components(steps, roots, reduce(DataFrame.unionByName, more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``class_id`` (smallest id of its class), ``rep_id``, ``class_size``, ``kept``.

    ``rep_id`` is the smallest id with exactly these words; one row of each class is ``kept``,
    that whose id is ``class_id``; rows that repeat that id are all kept (ids name documents). Texts
    without any word (null ones too) are all alike and form one class of empty documents. Very long texts are
    compared whole; a pair costs the product of its length and the edits it needs. Rows without an
    id join the class of their words; if no row with these words has an id, ``class_id`` is
    null and the row is kept. Rows that share an id but not their words are one node, by the words of
    one of them. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    with Steps(docs.sparkSession) as steps:
        rows = steps.written(map_texts(texts, sketch, f"_id {kind}, _same binary, _bands array<bigint>"), "sketch")
        first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_bands")))
        nodes = steps.written(rows.groupBy("_same").agg(first.alias("n"), F.count(F.lit(1)).alias("_k")).select("_same", "_k", "n.*"), "nodes")
        roots = classes(steps, nodes.filter("_id is not null"), texts.filter("_id is not null"))

        known = with_class(nodes, roots).select("_same", "_k", F.col("_id").alias("rep_id"), F.col("_root").alias("class_id"))
        out = split_join(rows.select("_id", "_same"), steps.written(known, "known"), ["_same"], "_k").select("_id", "rep_id", "class_id")
        return written(with_size(steps, steps.written(out, "rows")).withColumnRenamed("_id", id_col), "near")


def with_size(steps: Steps, out: DataFrame) -> DataFrame:
    in_class = out.filter("class_id is not null")
    sizes = steps.written(in_class.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), "class-sizes")
    alone = out.filter("class_id is null").withColumn("class_size", F.lit(1).cast("long"))
    kept: Column = F.col("_id").eqNullSafe(F.col("class_id"))
    return split_join(in_class, sizes, ["class_id"], "class_size").unionByName(alone).select("_id", "class_id", "rep_id", "class_size", kept.alias("kept"))

"""Jaccard join of word shingles by PartEnum signatures.

A document is the set of its distinct ``SHINGLE``-word shingles. Two sets of s and t shingles whose similarity is ``SIMILARITY`` percent
or more differ in at most (s + t) / 9 of them, and t is at most 1.25 s. Sizes are cut into bands, so that partners lie in the same or in
neighbouring ones; two neighbouring bands share a tag, and k, the most that two sets of a tag can differ in, is known.

Under a tag the domain of shingles is dealt to partitions by hash. A shingle that only one of two sets has spoils one
partition. With small k there are k + 2 partitions and a signature for each two of them (enumeration): at most k are
spoilt, so two sets agree in one signature. With large k there are k + 1 and some more, each a signature
of its own. A partition without shingles makes no signature: these would be alike for sets that have nothing in common. If a set has more of
these than may be spared, it signs again with another dealing of the domain; of two partners, the one that is content first has
enough signatures in common with the other, which has signed under that dealing too.

Signatures are made once and are shuffled packed, six bytes each with the place of their text; 43 bits tell them apart, so some sets meet by chance.
Sets that share a signature are a bucket, and its set of smallest number is its pivot; buckets with the same pivot are one. They are compared
as ``near`` does it, by sketches of two to four bits a shingle; sets are listed only where these leave a pair: with the pivot, then different classes within a bucket, so copies are never paired with each other; what links is the exact intersection.

Words and shingles are told apart by 64-bit hashes, sets by 64 bits of a hash of all of theirs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import BUCKETS, LOWER, UPPER, Steps, WordHashes, arrow_texts, ascii_lower, in_buckets, map_texts, maybe_in, mix, only_ids, slices, split_join, whole_text, window_hashes, written

SHINGLE, SIMILARITY = 5, 80
#: Largest k with a signature for each two of k + 2 partitions.
ENUMERATED = 4
#: Dealings of the domain that a set tries; after the last one its empty partitions sign as well.
DEALINGS = 12
#: Signatures, or pairs that share one, that a task puts together.
FLUSH = 2_000_000
#: Bits of the smallest sketch.
WORD_BITS = 64
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, DEALINGS + 1, dtype=np.uint64) * _STEP


def ends() -> list[int]:
    """The largest size of each band: the next one ends where the last one's partners can end."""
    out = [1]
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, out[-1] * 100 // SIMILARITY))
    return out


ENDS = ends()


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles, in order. Fewer words than a shingle has are one."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOW).split()
    h = hashes.array(words)
    if 0 < len(h) < SHINGLE:
        return mix(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(window_hashes(h, SHINGLE))


def name_of(x: np.ndarray) -> int:
    """A set's own number."""
    return np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64).item()


@lru_cache(256)
def plan(tag: int) -> tuple[int, int, np.ndarray | None]:
    """Partitions under a tag, how many of its signatures may be empty, and which partitions each signature takes (None: its own)."""
    k = 2 * ENDS[tag] * (100 - SIMILARITY) // (100 + SIMILARITY)
    if k == 0:
        return 0, 0, None
    if k <= ENUMERATED:
        takes = np.zeros(((k + 2) * (k + 1) // 2, k + 2), np.uint64)
        for row, pair in zip(takes, combinations(range(k + 2), 2), strict=True):
            row[list(pair)] = 1
        return k + 2, 0, takes
    spare = k // 10 + 1
    return k + 1 + spare, spare, None


def signatures(x: np.ndarray) -> np.ndarray:
    """The signatures of a set of hashes under both tags of its size."""
    if not len(x):
        return np.empty(0, np.uint64)
    out = []
    band = bisect_left(ENDS, len(x))
    for tag in (band, band + 1):
        partitions, spare, takes = plan(tag)
        for dealing in range(DEALINGS if partitions else 0):
            dealt = mix(x + _SALTS[dealing])
            at = (dealt % np.uint64(partitions)).astype(np.int64)
            total, full = np.zeros(partitions, np.uint64), np.bincount(at, minlength=partitions) > 0
            np.add.at(total, at, mix(dealt))
            if takes is not None:
                total, full = takes @ total, takes @ full.astype(np.uint64) > 0
            keys = mix(mix(total + np.arange(len(total), dtype=np.uint64) * _STEP) + np.uint64(tag * DEALINGS + dealing))
            content = len(full) - np.count_nonzero(full) <= spare
            out.append(keys if not content and dealing == DEALINGS - 1 else keys[full])
            if content:
                break
    return np.concatenate([*out, np.empty(0, np.uint64)])


def alike(a: list, b: list, counts: Counter | None = None) -> bool:
    """Whether two sets, as lists, are similar enough; ``counts`` has those of ``a``."""
    has = counts if counts is not None else set(a)
    common = sum(x in has for x in b)
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)


def sketch_of(x: np.ndarray) -> bytes:
    """A bit for each of two to four times as many slots as the set has shingles: whether an odd number of its shingles are there.

    Each shingle that only one of two sets has makes at most one bit differ. Half as many slots are those of both halves, added.
    """
    slots = max(WORD_BITS, 1 << (2 * len(x) - 1).bit_length())
    odd = np.bincount((mix(x ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(slots)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bits_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """In how many shingles two sets differ at least, by their sketches."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def can_be(cp: pa.Array, n: np.ndarray, c: pa.Array, m: np.ndarray) -> np.ndarray:
    least = [differing(bits_of(a), bits_of(b)) for a, b in zip(cp.to_pylist(), c.to_pylist(), strict=True)]
    return np.array(least, np.int64) * (100 + SIMILARITY) <= (n.astype(np.int64) + m) * (100 - SIMILARITY)


def set_pairs(roots: list, n: np.ndarray, c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different classes that can be alike, by size and sketch; sizes are in order, so partners are next to each other."""
    order = np.argsort(n, kind="stable")
    n, root = n[order].astype(np.int64), np.unique(np.array(list(map(str, roots))), return_inverse=True)[1][order]
    sketches = [bits_of(x) for x in c.take(pa.array(order)).to_pylist()]
    same = {size: np.stack([s for s in sketches if len(s) == size]) for size in {len(s) for s in sketches}}
    first = {size: next(k for k, s in enumerate(sketches) if len(s) == size) for size in same}
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for i, a in enumerate(sketches):
        last = int(np.searchsorted(n, n[i] * 100 // SIMILARITY, "right"))
        for size in (len(a), 2 * len(a)):  # a partner has as many slots, or twice as many
            if size not in same:
                continue
            low, high = max(i + 1, first[size]), min(last, first[size] + len(same[size]))
            if low < high:
                b = same[size][low - first[size] : high - first[size]]
                b = b if size == len(a) else b[:, : len(a)] ^ b[:, len(a) :]
                can = (np.bitwise_count(b ^ a).sum(axis=1, dtype=np.int64) * (100 + SIMILARITY) <= (n[i] + n[low:high]) * (100 - SIMILARITY)) & (root[low:high] != root[i])
                j = np.flatnonzero(can) + low
                found[0].append(np.full(len(j), i))
                found[1].append(j)
    left, right = map(np.concatenate, found)
    return order[left.astype(np.int64)], order[right.astype(np.int64)]


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch, texts in arrow_texts(batches):
        yield batch, [shingles(t, hashes) for t in texts]


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (_d, _id, _size, _t) for each text, and for some thousand texts a row (_base, _sigs, _at) for each bucket of signatures.

    A text is numbered ``_d`` by its place among these texts; a signature takes four bytes, the place of its text two.
    """
    texts, many = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        names, sizes, types, keys = (list(x) for x in zip(*texts, strict=True))
        names = np.array(names, np.int64)
        base = xxhash.xxh3_64_intdigest(names.tobytes())
        numbers = numbered(np.uint64(base), np.arange(len(names)))
        yield rows_of(_key=(numbers % np.uint64(BUCKETS)).astype(np.int32), _d=numbers.view(np.int64), _id=names, _size=np.array(sizes, np.int64), _t=types)
        order, ends, kept = in_buckets(np.concatenate(keys))
        at = np.repeat(np.arange(len(names), dtype=np.uint16), list(map(len, keys)))[order]
        full = np.flatnonzero(np.diff(ends, prepend=0))
        bases = np.full(len(full), base, np.uint64).view(np.int64)
        yield rows_of(_key=full.astype(np.int32), _base=bases, _sigs=slices(kept, ends[full]), _at=slices(at, ends[full]))

    for batch, sets in sets_of(batches):
        for x, t in zip(sets, batch.column("_t").to_pylist(), strict=True):
            keys = signatures(x)
            texts.append((name_of(x), len(x), t, keys))
            many += len(keys)
            if many >= FLUSH or len(texts) == 1 << 16:
                yield from flush()
                texts, many = [], 0
    if texts:
        yield from flush()


def numbered(base: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(base + at.astype(np.uint64))


SIGNED = pa.schema({"_key": pa.int32(), "_base": pa.int64(), "_sigs": pa.binary(), "_at": pa.binary(), "_d": pa.int64(), "_id": pa.int64(), "_size": pa.int64(), "_t": pa.binary()})


def rows_of(**columns) -> pa.RecordBatch:
    n = len(columns["_key"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SIGNED], schema=SIGNED)


def sharing(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's rows, the numbers of the pivot and of each text for all signatures that occur twice; the smallest number is the pivot."""
    sigs = [np.frombuffer(x, np.uint32) for x in rows.column("_sigs").to_pylist()]
    base = np.repeat(rows.column("_base").to_numpy().view(np.uint64), list(map(len, sigs)))
    at = np.frombuffer(b"".join(rows.column("_at").to_pylist()), np.uint16)
    both = np.sort(np.concatenate(sigs).astype(np.uint64) << np.uint64(32) | np.arange(len(at), dtype=np.uint64))
    key = both >> np.uint64(32)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key)))
    place = (both & np.uint64(0xFFFFFFFF))[np.repeat(n > 1, n)]
    d, n = numbered(base[place], at[place]), n[n > 1]
    least = np.minimum.reduceat(d, np.cumsum(n) - n) if len(n) else d
    return np.repeat(least, n), d


def met_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of ``signed`` (_d, _id, _size, _t), and those (_p, _d) that share a signature, with its pivot ``_p``."""
    held, many = [], 0

    def pairs() -> pa.RecordBatch:
        p, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((d, p))
        p, d = p[order], d[order]
        new = np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])) if len(p) else np.empty(0, bool)
        p, d = (pa.array(x[new].view(np.int64)) for x in (p, d))
        return pa.RecordBatch.from_arrays([p, d, *(pa.nulls(len(p), SIGNED.field(c).type) for c in ("_id", "_size", "_t"))], ["_p", "_d", "_id", "_size", "_t"])

    for rows in near.runs_by_key(batches):
        texts = rows.filter(rows.column("_sigs").is_null()).combine_chunks()
        yield from texts.select(["_d", "_id", "_size", "_t"]).add_column(0, "_p", pa.nulls(len(texts), pa.int64())).to_batches()
        rows = rows.filter(rows.column("_sigs").is_valid())
        cut = near.group_ends(rows.column("_key").to_numpy())
        for a, z in zip(cut, cut[1:]):
            if a < z:
                held.append(sharing(rows.slice(a, z - a)))
                many += len(held[-1][0])
        if many >= FLUSH:
            yield pairs()
            held, many = [], 0
    if held:
        yield pairs()


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in sets_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array(list(map(name_of, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(sketch_of, sets)), pa.binary())], ["_id", "_w", "_c"])


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in sets_of(batches):
        sizes = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))
        counts = pa.array([sketch_of(x) for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in sets], pa.int64()), lists, pa.array(list(map(len, sets)), pa.int32()), counts], ["_id", "_x", "_w", "_c"])


def buckets_of(steps: Steps, found: DataFrame) -> DataFrame:
    """Buckets (_key, _id, _n, _p): for each pivot all sets that share a signature of which it is the pivot, with itself."""
    names = steps.written(found.filter("_p is null").select("_d", "_id").dropDuplicates(["_d"]), "names")
    pairs = steps.written(found.filter("_p is not null").select("_p", "_d").distinct(), "pairs")
    pivots = pairs.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).join(names.select(F.col("_d").alias("_p"), F.col("_id").alias("_pivot")), "_p")
    met = split_join(pairs, steps.written(pivots, "pivots"), ["_p"], "_n").join(names, "_d")
    met = steps.written(met.select(F.col("_pivot").alias("_p"), "_id").distinct(), "met")
    sizes = steps.written(met.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "sizes")
    return steps.written(split_join(met, sizes, ["_p"], "_n").withColumn("_key", F.xxhash64("_p")), "buckets")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``, ``set_size`` (documents of the same set).

    Words are runs of anything but space and \\x09-\\x0D, lower-cased (A-Z). Two documents link when 100 times their common
    shingles are ``SIMILARITY`` times those of both or more; ``component_id`` is the smallest id that links reach.
    Fewer than ``SHINGLE`` words are one shingle. Null and empty texts, and those without words, have none, link with nothing and are
    each their own component. Very long texts are taken whole. Rows that are repeated or share an id are told apart by
    their sets only; rows without an id link as all others do, but name no component: if no row of theirs has an id, it
    is null. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("_doc"), whole_text(text_col).alias("_text"))
    # never null, so that no join computes it a second time to tell
    texts = texts.withColumn("_t", F.coalesce(F.unhex(F.md5(ascii_lower("_text"))), F.lit(b"")))

    def of(ids: DataFrame) -> DataFrame:
        """Rows with an id of the written ``ids``, and some more by chance: those sign for sets that are known."""
        tried = maybe_in(texts.withColumn("_none", F.col("_doc").isNull()), [F.col("_doc")], ids.filter("_doc is not null"))
        return tried.filter("_maybe or _none")

    with Steps(docs.sparkSession) as steps:
        alike_texts = steps.written(texts.groupBy("_t").agg(F.min("_doc").alias("_doc"), F.count(F.lit(1)).alias("_k")), "texts")
        once = of(alike_texts.select("_doc"))
        dealt = map_texts(once.select("_text", "_t"), signed, "_key int, _base bigint, _sigs binary, _at binary, _d bigint, _id bigint, _size bigint, _t binary")
        found = map_texts(dealt.repartition("_key").sortWithinPartitions("_key"), met_in_buckets, "_p bigint, _d bigint, _id bigint, _size bigint, _t binary")
        found = steps.written(found, "signed")
        sets = found.filter("_p is null").groupBy("_t").agg(F.first("_id").alias("_id"), F.first("_size").alias("_size"))
        sets = steps.written(alike_texts.join(sets, "_t"), "sets")
        buckets = buckets_of(steps, found)

        members = steps.written(buckets.select("_id").distinct(), "members")
        wanted = steps.written(sets.join(members, "_id", "left_semi").groupBy("_id").agg(F.min("_doc").alias("_doc")), "wanted")

        def of_sets(ids: DataFrame, docs_of: DataFrame, run: Callable, schema: str, label: str) -> DataFrame:
            """What ``run`` makes of the sets of the written ``ids``, each once; ``docs_of`` has these and a document of each."""
            chosen = steps.written(docs_of.select("_doc").filter("_doc is not null").distinct(), "wanted-ids")
            listing = only_ids(texts.filter("_doc is not null"), "_doc", chosen).unionByName(texts.filter("_doc is null"))
            made = steps.written(only_ids(map_texts(listing.select("_text"), run, schema), "_id", ids), label)
            return steps.written(made.dropDuplicates(["_id"]), f"{label}-once") if made.count() > ids.count() else made  # repeated ids, or none

        def lists(ids: DataFrame) -> DataFrame:
            return of_sets(ids, wanted.join(ids, "_id", "left_semi"), listed, "_id bigint, _x array<bigint>, _w int, _c binary", "lists")

        few = of_sets(members, wanted, sketched, "_id bigint, _w int, _c binary", "sketches")
        roots = near.linked(steps, buckets, few, near.Likeness(alike, can_be, set_pairs), lists)

        nodes = sets.filter("_size > 0").groupBy("_id").agg(F.min("_doc").alias("_first"), F.sum("_k").alias("set_size"), F.count(F.lit(1)).alias("_c"))
        known = steps.written(near.with_class(nodes, roots), "known")
        least = steps.written(known.groupBy("_root").agg(F.min("_first").alias("component_id"), F.count(F.lit(1)).alias("_n")), "least")
        known = steps.written(split_join(known, least, ["_root"], "_n").select("_id", "_c", "set_size", "component_id"), "components")
        of_text = split_join(sets.filter("_size > 0"), known, ["_id"], "_c").select("_t", "_k", F.col("_size").alias("n_shingles"), "component_id", "set_size")
        of_text = of_text.unionByName(sets.filter("_size = 0").select("_t", "_k", F.col("_size").alias("n_shingles"), F.lit(None).cast(texts.schema["_doc"].dataType).alias("component_id"), F.lit(1).cast("bigint").alias("set_size")))
        out = split_join(texts.select("_doc", "_t"), steps.written(of_text, "of-text"), ["_t"], "_k")
        own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_doc"))
        return written(out.select(F.col("_doc").alias(id_col), "n_shingles", own.alias("component_id"), "set_size"), "jaccard")

"""Phrase collocations by best-first branch and bound over prefixes.

A phrase of 2 to 4 words with ``a`` occurrences scores floor(2000000 a / (l + r)) at a cut into parts of
``l`` and ``r`` occurrences; its lowest cut counts. Let L be the occurrences of its first word. Whatever begins
with a prefix of ``p`` occurrences has a <= p, a left part of L at its first cut and a right part of a at least, so
it scores at most floor(2000000 p / (L + p)): counts of prefixes alone bound all that can grow from
them. Words and pairs are counted once. Then, in rounds, the frontier's prefixes of best bound are grown
by one word on both sides in one scan, which finds longer phrases and tells which phrases a longer one covers. It
ends when no prefix that has not been grown has a bound as good as its language's ``top``-th surviving score; ties go on growing.

A word is its 64-bit hash while phrases are counted. Each task sums what it has counted before anything is shuffled, so a frequent
phrase or a language of most rows is no hot key. Which phrases a scan grows is told by a table of bits of
32 MB at most: it may count some that were not asked for, and counts all it counts completely.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKETS, LOWER, SLOTS, SLOTS_A_ROW, UPPER, Steps, WordHashes, arrow_texts, in_buckets, map_texts, mix, slices, whole_text, written
from .near import group_ends, runs_by_key

LEAST, TOP, COVERED, SCALE = 30, 2000, 80, 2_000_000
#: Words that are counted together before their sums leave the task.
FLUSH = 1_000_000
#: Stands for the end of a piece; no word can be like it.
BREAK = b"."
_SIGNS = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
PHRASE = ("_1", "_2", "_3", "_4")


def tokens(text: str) -> list[bytes]:
    """The words of ``text``, A-Z lower-cased, with ``BREAK`` between pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_SIGNS).replace(b"\n", b" " + BREAK + b" ").split()


class Codes(WordHashes):
    """Hashes of words; 0 for ``BREAK``."""

    def __missing__(self, word):
        return 0 if word == BREAK else super().__missing__(word)


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as the hashes of its words, 0 between pieces, and how many words these are."""
    codes = Codes()
    for batch, texts in arrow_texts(batches):
        x = [codes.array(tokens(t)) for t in texts]
        sizes = np.cumsum([0, *map(len, x)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*x, np.empty(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("_lang"), lists, pa.array([np.count_nonzero(h) for h in x], pa.int64())], ["_lang", "_w", "_n"])


def spelled(asked):
    """The words (_lang, _word, _h) whose bit is set in ``asked``, once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, wanted = Codes(), Bits(asked.value)
        for batch, texts in arrow_texts(batches):
            seen: dict[str, set] = {}
            for lang, text in zip(batch.column("_lang").to_pylist(), texts, strict=True):
                seen.setdefault(lang, set()).update(tokens(text))
            for lang, words in seen.items():
                words = list(words - {BREAK})
                h = codes.array(words)
                at = np.flatnonzero(wanted.has(keys_of(lang, [h])))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([words[k] for k in at], pa.binary()).cast(pa.string()), pa.array(h[at].view(np.int64))], ["_lang", "_word", "_h"])

    return run


def keys_of(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase; ``words`` has an array for each place."""
    key = mix(words[0] + np.uint64(xxhash.xxh3_64_intdigest(lang)))
    for w in words[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key


class Bits:
    """A set of phrases as bits of their hashes: never false for one that is in it."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(8 * len(bits))

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys % self.size
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def slots_as_bits(keys: DataFrame, name: str):
    """The hashes of the written table ``keys`` as broadcast bits: 32 for each, ``SLOTS`` at most."""
    size = min(SLOTS, max(SLOTS_A_ROW, 1 << (32 * keys.count()).bit_length()))
    slot = F.col(name).bitwiseAND(F.lit(size - 1))  # sizes are powers of two
    rows = keys.groupBy(F.floor(slot / SLOTS_A_ROW).alias("r")).agg(F.bitmap_construct_agg(slot % SLOTS_A_ROW).alias("b"))
    bits = np.zeros(size // 8, np.uint8)
    for r, b in rows.collect():
        bits[r * SLOTS_A_ROW // 8 :][: SLOTS_A_ROW // 8] = np.frombuffer(bytes(b), np.uint8)[: size // 8]
    return keys.sparkSession.sparkContext.broadcast(bits)


def hashed_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("_lang").to_pylist(), object)
        words = [batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in PHRASE]
        length = sum(np.array(batch.column(c).is_valid()).astype(int) for c in PHRASE)
        for lang in set(langs.tolist()):
            for m in (1, 2, 3):
                at = np.flatnonzero((langs == lang) & (length == m))
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(lang, [w[at] for w in words[:m]]).view(np.int64))], ["k"])


def bits_of(steps: Steps, phrases: DataFrame):
    """The phrases (_lang, _1 .. _4; null where shorter) as broadcast ``Bits``."""
    return slots_as_bits(steps.written(phrases.select("_lang", *PHRASE).mapInArrow(hashed_phrases, "k bigint"), "hashes"), "k")


def summed(lang: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    """How often each row of ``columns`` occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    words = [pa.array(c[first].view(np.int64)) for c in columns]
    words += [pa.nulls(len(first), pa.int64())] * (len(PHRASE) - len(words))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *words, pa.array(n, pa.int64())], ["_lang", *PHRASE, "_n"])


def scanned(found: Callable[[str, np.ndarray], Iterator[list[np.ndarray]]], summed: Callable = summed):
    """Runs ``found`` on the words of one language at a time, ``FLUSH`` of them or one text, and sums the phrases it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            for columns in found(lang, np.concatenate(held.pop(lang))):
                if len(columns[0]):
                    yield summed(lang, columns)

        for batch in batches:
            for lang, w in zip(batch.column("_lang").to_pylist(), batch.column("_w"), strict=True):
                held.setdefault(lang, []).extend((w.values.to_numpy().view(np.uint64), np.zeros(1, np.uint64)))
                size[lang] += len(w.values) + 1
                if size[lang] >= FLUSH:
                    yield from flush(lang)
                elif size.total() >= 4 * FLUSH:  # many languages, each with few words
                    yield from flush(size.most_common(1)[0][0])
        for lang in list(held):
            yield from flush(lang)

    return run


PACKED = "_key int, _one binary, _more binary, _times binary"


def packed(lang: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    """How often each hash of the only column occurs, a row for each bucket: hashes that occur once, the others, and how often these do."""
    keys, n = np.unique(columns[0] & np.uint64((BUCKETS << 32) - 1), return_counts=True)
    once = n == 1
    _, one_ends, ones = in_buckets(keys[once])
    order, more_ends, more = in_buckets(keys[~once])
    times = n[~once][order].astype(np.uint32)
    full = np.flatnonzero(np.diff(one_ends, prepend=0) + np.diff(more_ends, prepend=0))
    parts = [pa.array(slices(x, ends[full]), pa.binary()) for x, ends in ((ones, one_ends), (more, more_ends), (times, more_ends))]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *parts], ["_key", "_one", "_more", "_times"])


def frequent_hashes(least: int):
    """The hashes (k) of ``packed`` rows, sorted by bucket, that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_by_key(batches):
            bucket = rows.column("_key").to_numpy()
            cut = group_ends(bucket)
            for a, z in zip(cut, cut[1:]):
                one, more, times = (np.frombuffer(b"".join(rows.column(c).slice(a, z - a).to_pylist()), np.uint32) for c in ("_one", "_more", "_times"))
                keys, n = np.concatenate([one, more]), np.concatenate([np.ones(len(one), np.int64), times.astype(np.int64)])
                order = np.argsort(keys)
                keys, n = keys[order], n[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                often = keys[first[np.add.reduceat(n, first) >= least]].astype(np.uint64) | np.uint64(int(bucket[a]) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64))], ["k"])

    return run


def words_in(lang: str, w: np.ndarray) -> Iterator[list[np.ndarray]]:
    yield [w[w != 0]]


def pairs_in(frequent) -> Callable:
    """Pairs of ``frequent`` words."""

    def found(lang: str, w: np.ndarray) -> Iterator[list[np.ndarray]]:
        ok = (w != 0) & Bits(frequent.value).has(keys_of(lang, [w]))
        at = np.flatnonzero(ok[:-1] & ok[1:])
        yield [w[at], w[at + 1]]

    return found


def grown_in(frequent, asked) -> Callable:
    """Phrases that are one of ``asked`` with one word more, before or after it, if all their pairs are ``frequent``."""

    def found(lang: str, w: np.ndarray) -> Iterator[list[np.ndarray]]:
        known, wanted = Bits(frequent.value), Bits(asked.value)
        pair = np.flatnonzero((w[:-1] != 0) & (w[1:] != 0))
        key = keys_of(lang, [w[pair], w[pair + 1]])
        is_pair, grows2, grows3 = (np.zeros(len(w) + 2, bool) for _ in range(3))
        is_pair[pair] = known.has(key)
        grows2[pair] = wanted.has(key)
        three = np.flatnonzero(is_pair[:-1] & is_pair[1:])
        hit = three[grows2[three] | grows2[three + 1]]
        yield [w[hit], w[hit + 1], w[hit + 2]]
        grows3[three] = wanted.has(keys_of(lang, [w[three], w[three + 1], w[three + 2]]))
        four = three[is_pair[three + 2]]
        hit = four[grows3[four] | grows3[four + 1]]
        yield [w[hit], w[hit + 1], w[hit + 2], w[hit + 3]]

    return found


SUMS = "_lang string, _1 bigint, _2 bigint, _3 bigint, _4 bigint, _n bigint"


def counted(steps: Steps, words: DataFrame, found: Callable, least: int) -> DataFrame:
    """(_lang, _1 .. _4, a): phrases that ``found`` gives ``least`` times or more.

    Most phrases are rarer. So their hashes alone are counted first, 43 bits of each in four bytes, then the phrases whose hashes are frequent.
    """

    def hashes(lang: str, w: np.ndarray) -> Iterator[list[np.ndarray]]:
        return ([keys_of(lang, columns)] for columns in found(lang, w))

    dealt = words.mapInArrow(scanned(hashes, packed), PACKED).repartition("_key").sortWithinPartitions("_key")
    often = dealt.mapInArrow(frequent_hashes(least), "k bigint")
    keys = slots_as_bits(steps.written(often, "often"), "k")

    def these(lang: str, w: np.ndarray) -> Iterator[list[np.ndarray]]:
        for columns in found(lang, w):
            has = Bits(keys.value).has(keys_of(lang, columns))
            yield [c[has] for c in columns]

    return words.mapInArrow(scanned(these), SUMS).groupBy("_lang", *PHRASE).agg(F.sum("_n").alias("a")).filter(F.col("a") >= least)


def score_of(a: Column, parts: Column) -> Column:
    """floor(SCALE a / parts), exact beyond 64 bits."""
    whole = F.lit(SCALE).cast("decimal(8,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", whole, parts.cast("decimal(20,0)"))


def lowest_cut(cuts: list[tuple[str, str]]) -> list[Column]:
    """``l``, ``r`` and ``score`` of the lowest of the cuts into columns (l, r); the first one of equals."""
    each = [F.struct(score_of(F.col("a"), F.col(x) + F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts)]
    least = F.array_min(F.array(*each))
    return [least["l"].alias("l"), least["r"].alias("r"), least["score"].alias("score")]


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with the counts of both words (_f1, _f2), their score and the bound of all that begins with them."""
    one = lambda k: words.select("_lang", F.col("_1").alias(f"_{k}"), F.col("a").alias(f"_f{k}"))
    both = pairs.join(one(1), ["_lang", "_1"]).join(one(2), ["_lang", "_2"])
    return both.select("*", *lowest_cut([("_f1", "_f2")]), score_of(F.col("a"), F.col("_f1") + F.col("a")).alias("bound"))


def scored_threes(threes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases of three words with the counts of their parts: _f1, _f12, _f23, _f3."""
    left = pairs.select("_lang", "_1", "_2", "_f1", F.col("a").alias("_f12"))
    right = pairs.select("_lang", F.col("_1").alias("_2"), F.col("_2").alias("_3"), F.col("_f2").alias("_f3"), F.col("a").alias("_f23"))
    both = threes.join(left, ["_lang", "_1", "_2"]).join(right, ["_lang", "_2", "_3"])
    return both.select("*", *lowest_cut([("_f1", "_f23"), ("_f12", "_f3")]), score_of(F.col("a"), F.col("_f1") + F.col("a")).alias("bound"))


def scored_fours(fours: DataFrame, threes: DataFrame) -> DataFrame:
    """Phrases of four words both of whose phrases of three are known."""
    left = threes.select("_lang", "_1", "_2", "_3", "_f1", "_f12", F.col("a").alias("_f123"))
    right = threes.select("_lang", *[F.col(f"_{k}").alias(f"_{k + 1}") for k in (1, 2, 3)], F.col("a").alias("_f234"), F.col("_f23").alias("_f34"), F.col("_f3").alias("_f4"))
    both = fours.join(left, ["_lang", "_1", "_2", "_3"]).join(right, ["_lang", "_2", "_3", "_4"])
    return both.select("*", *lowest_cut([("_f1", "_f234"), ("_f12", "_f34"), ("_f123", "_f4")]), F.lit(None).cast("bigint").alias("bound"))


def most_of_longer(longer: DataFrame, m: int) -> DataFrame:
    """For the phrases of m words at both ends of those of m + 1: the most occurrences of such a longer one."""
    ends = [longer.select("_lang", *[F.col(f"_{k + 1 + s}").alias(f"_{k + 1}") for k in range(m)], "a") for s in (0, 1)]
    return ends[0].unionByName(ends[1]).groupBy("_lang", *PHRASE[:m]).agg(F.max("a").alias("_longer"))


def nth_score(rows: DataFrame, n: int) -> DataFrame:
    """(_lang, _at): the n-th best score of each language that has so many."""
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("score")))
    return rows.select("_lang", "score").withColumn("_rank", rank).filter(F.col("_rank") <= n).filter(F.col("_rank") == n).select("_lang", F.col("score").alias("_at"))


def at_least(rows: DataFrame, column: str, least: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not below their language's threshold; languages without one keep all rows."""
    return rows.join(least, "_lang", "left").filter(F.col("_at").isNull() | (F.col(column) >= F.col("_at"))).drop("_at")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. A phrase
    is 2 to 4 words of a piece that occur ``least`` times in its language. It is left out if a longer one that has it inside
    occurs ``covered`` percent as often or more. ``l`` and ``r`` are those of the lowest cut, the first of equals;
    ``n`` counts all words of the language. Order: score, then ``a``, both descending, then phrase by UTF-8 bytes.

    A null language is ``und``. Null and empty texts have no words; very long ones and long words are read whole. Rows that are repeated
    count each time. Ties at any rank are settled by the order. Other columns are ignored, whatever their
    names. An empty table, or one without such phrases, gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), whole_text(text_col).alias("_text"))
    with Steps(docs.sparkSession) as steps:
        coded = steps.written(map_texts(texts, encoded, "_lang string, _w array<bigint>, _n bigint"), "coded")
        totals = coded.groupBy("_lang").agg(F.sum("_n").alias("n"))
        coded = coded.select("_lang", "_w")
        words = steps.written(counted(steps, coded, words_in, least), "words")
        none = [F.lit(None).cast("bigint").alias(c) for c in PHRASE]
        frequent = bits_of(steps, words)
        pairs = steps.written(scored_pairs(counted(steps, coded, pairs_in(frequent), least), words), "pairs")
        known = bits_of(steps, pairs)
        threes = steps.written(scored_threes(pairs.select("_lang", *PHRASE, "a").limit(0), pairs), "threes")
        fours = steps.written(scored_fours(threes.select("_lang", *PHRASE, "a"), threes), "fours")
        seen4 = fours.select("_lang", *PHRASE, "a")
        grown = pairs.select("_lang", *PHRASE).limit(0)
        shown = ["_lang", *PHRASE, "a", "l", "r", "score", "bound"]

        least_score = nth_score(pairs, 2 * top)  # only the first round's guess at what is best
        while True:
            every = pairs.select(shown).unionByName(threes.select(shown))
            asked = at_least(every.select("_lang", *PHRASE, "bound"), "bound", least_score).select("_lang", *PHRASE)
            asked = steps.written(without(asked, grown), "asked")
            if asked.isEmpty():
                break
            # what a phrase of four begins and ends with is counted by the same scan
            inner = asked.filter("_3 is not null").select("_lang", F.col("_2").alias("_1"), F.col("_3").alias("_2"), *none[2:])
            asked = steps.written(asked.unionByName(without(inner, grown)).distinct(), "growing")
            bits = bits_of(steps, asked)
            found = steps.written(counted(steps, coded, grown_in(known, bits), least), "found")
            grown = steps.written(grown.unionByName(asked), "grown")
            more = without(found.filter("_4 is null"), threes)
            threes = steps.written(threes.unionByName(scored_threes(more, pairs)), "threes")
            seen4 = steps.written(seen4.unionByName(without(found.filter("_4 is not null"), seen4)), "seen")
            fours = steps.written(scored_fours(seen4, threes), "fours")
            left = steps.written(surviving(pairs, threes, fours, seen4, grown, covered, shown), "left")
            least_score = nth_score(left, top)

        if grown.isEmpty():
            left = steps.written(pairs.select(shown), "left")
        best = steps.written(at_least(left, "score", least_score), "best")
        at = best.withColumn("_row", F.monotonically_increasing_id()).select("_lang", "_row", *PHRASE, "a", "l", "r", "score")
        at = steps.written(at, "numbered")
        parts = at.select("_lang", "_row", F.posexplode(F.array(*PHRASE)).alias("_p", "_h")).filter("_h is not null")
        asked = bits_of(steps, parts.select("_lang", F.col("_h").alias("_1"), *none[1:]).distinct())
        names = map_texts(texts, spelled(asked), "_lang string, _word string, _h bigint").groupBy("_lang", "_h").agg(F.first("_word").alias("_word"))
        parts = parts.join(names, ["_lang", "_h"])
        phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_word"))), lambda x: x["_word"]), " ")
        phrases = parts.groupBy("_row").agg(phrase.alias("phrase"))
        rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        out = at.join(phrases, "_row").withColumn("_rank", rank).filter(F.col("_rank") <= top).join(totals, "_lang")
        return written(out.select(F.col("_lang").alias("lang"), F.col("_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose phrase is not in ``gone``."""
    gone = gone.select("_lang", *PHRASE)
    same = reduce(lambda x, c: x & rows[c].eqNullSafe(gone[c]), PHRASE, rows["_lang"] == gone["_lang"])
    return rows.join(gone, same, "left_anti")


def surviving(pairs: DataFrame, threes: DataFrame, fours: DataFrame, seen4: DataFrame, grown: DataFrame, covered: int, shown: list[str]) -> DataFrame:
    """Phrases that are known to stay: they have been grown, or are of four words, and no longer one covers them."""
    kept = [fours.select(shown)]
    for m, rows, longer in ((2, pairs, threes), (3, threes, seen4)):
        key = ["_lang", *PHRASE[:m]]
        of_size = grown.filter("_3 is null" if m == 2 else "_3 is not null").select(key)
        looked_at = rows.select(shown).join(of_size, key, "left_semi").join(most_of_longer(longer, m), key, "left")
        kept.append(looked_at.filter(F.col("_longer").isNull() | (100 * F.col("_longer").cast("decimal(20,0)") < covered * F.col("a").cast("decimal(20,0)"))).select(shown))
    return reduce(DataFrame.unionByName, kept)

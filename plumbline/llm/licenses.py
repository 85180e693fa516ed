"""License scan by fuzzy search for short notices.

A notice that occurs with at most e edits has one of any e + 1 pieces of it unharmed. So
each notice is split in e + 1 pieces, all pieces are searched for at once, and around each
hit the regex library's bounded-error matching verifies the edits and gives the span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, map_texts, whole_text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Phrases that are looked for word by word, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices as their lower-cased words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "spdx license identifier mit": "mit",
    "licensed under the apache license version 2 0": "apache",
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache",
    "spdx license identifier apache 2 0": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version": "gpl",
    "spdx license identifier gpl": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "spdx license identifier lgpl": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "spdx license identifier agpl": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties": "bsd",
    "licensed under the bsd 3 clause license": "bsd",
    "spdx license identifier bsd": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl",
    "spdx license identifier mpl 2 0": "mpl",
    "made available under the terms of the eclipse public license": "epl",
    "subject to the terms of the common development and distribution license": "cddl",
    "distributed under the boost software license version 1 0": "boost",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "dedicated to the public domain under cc0 1 0 universal": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "do what the fuck you want to public license": "wtfpl",
    "all rights reserved": "all-rights-reserved",
}

#: One edit for so many characters of a notice, one at least.
CHARS_PER_EDIT = 14
LONGEST = max(map(len, NOTICES)) * (CHARS_PER_EDIT + 1) // CHARS_PER_EDIT


def edit_budget(notice: str) -> int:
    return max(1, len(notice) // CHARS_PER_EDIT)


@cache
def tables() -> tuple[ahocorasick.Automaton, dict[str, regex.Pattern]]:
    """The automaton of all pieces, each with its (notice, offset), and the fuzzy pattern of each notice."""
    pieces: dict[str, list[tuple[str, int]]] = {}
    for notice in NOTICES:
        n = edit_budget(notice) + 1
        cuts = [len(notice) * i // n for i in range(n + 1)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(notice[a:b], []).append((notice, a))
    found = ahocorasick.Automaton()
    for piece, where in pieces.items():
        found.add_word(piece, (len(piece), where))
    found.make_automaton()
    return found, {n: regex.compile(rf"(?b)(?:{regex.escape(n)}){{e<={edit_budget(n)}}}") for n in NOTICES}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


@cache
def grams(notice: str) -> frozenset[str]:
    return frozenset(notice[k : k + 3] for k in range(len(notice) - 2))


def places(text: str) -> dict[str, list[tuple[int, int, int]]]:
    """(start, end, edits) of each notice in ``text``: of each exact piece the best match within its window that has the piece inside."""
    automaton, patterns = tables()
    seeds: dict[str, list[tuple[int, int, int]]] = {}
    for last, (n, where) in automaton.iter(text):
        for notice, offset in where:
            seeds.setdefault(notice, []).append((last + 1 - n, n, offset))
    out = {}
    for notice, found in seeds.items():
        most, kept = edit_budget(notice), []
        for p, n, offset in sorted(found):
            if kept and kept[-1][0] <= p and p + n <= kept[-1][1] and abs(p - kept[-1][0] - offset) <= most:
                continue  # another piece of the same place
            a = max(p - offset - most, 0)
            z = min(p - offset + len(notice) + most, len(text))
            window = text[a:z]
            if sum(g not in window for g in grams(notice)) > 3 * most:
                continue  # an edit takes away three of the notice's trigrams at most
            while m := patterns[notice].search(text, a, z):
                s, e = m.span()
                if s <= p and p + n <= e:
                    s, e = s + (text[s : s + 1] == " "), e - (text[e - 1 : e] == " ")
                    hit = s, e, sum(m.fuzzy_counts)
                    if not kept or kept[-1][1] <= s:
                        kept.append(hit)
                    elif hit[2] < kept[-1][2]:  # places that overlap are one, the closest
                        kept[-1] = hit
                    break
                a, z = (s + 1, z) if s < p else (a, e - 1)  # a neighbour's place
        out[notice] = kept
    return out


def fuzzy(text: str) -> list[tuple[str, int, int, int]]:
    """(notice, start, end, edits) in ``text``, words joined by single spaces; places of a notice don't overlap.

    Where notices of different licenses overlap, only those with the fewest edits count.
    """
    found = [(*hit, notice) for notice, hits in places(text).items() for hit in hits]
    found.sort()
    out: list[tuple[int, int, int, str]] = []
    for hit in found:
        s, _, edits, notice = hit
        rivals, k = [], len(out) - 1
        while k >= 0 and s - out[k][0] <= LONGEST:  # those that begin earlier and may reach here
            if out[k][1] > s and NOTICES[out[k][3]] != NOTICES[notice]:
                rivals.append(k)
            k -= 1
        if any(out[k][2] < edits for k in rivals):
            continue
        for k in rivals:
            if out[k][2] > edits:
                out.pop(k)
        out.append(hit)
    return [(notice, s, e, edits) for s, e, edits, notice in out]


def find(words: list[str]) -> tuple[list[dict], float]:
    """The notices among the words, and the best likeness of any (1: word for word)."""
    text = " ".join(words)
    padded = f" {text} "
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    word_at = lambda c: bisect_right(starts, c) - 1
    out, score = [], 0.0
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            first = word_at(at)
            out.append({"label": label, "base": True, "first_word": first, "last_word": first + phrase.count(" "), "edits": 0})
            score = 1.0
            at = padded.find(f" {phrase} ", at + 1)
    for notice, s, e, edits in fuzzy(text):
        out.append({"label": NOTICES[notice], "base": False, "first_word": word_at(s), "last_word": word_at(max(s, e - 1)), "edits": edits})
        score = max(score, 1 - edits / len(notice))
    out.sort(key=lambda x: (x["first_word"], not x["base"], x["label"]))
    return out, score


SPANS = "array<struct<label:string,base:boolean,first_word:bigint,last_word:bigint,edits:int>>"
_TYPE = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in arrow_texts(batches):
        words = [words_of(t) for t in texts]
        found = [find(w) for w in words]
        columns = [pa.array(list(map(len, words)), pa.int64()), pa.array([f[0] for f in found], _TYPE), pa.array([f[1] for f in found], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["_id", "n_words", "notices", "score"])


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``notices``, ``score``.

    ``notices`` has (label, base, first_word, last_word, edits) by first word: ``base`` ones are
    the phrases, word for word, the others were found by fuzzy search. ``score`` is the best
    likeness, 1 for a phrase, 1 - edits / characters for a notice, 0 without either. Null
    and empty texts have no words; very long ones are searched whole, in time proportional to their length.
    Repeated rows and null ids are kept as they are; an empty table gives an empty result. Nothing is shuffled.
    """
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(texts, _run, f"_id {kind}, n_words bigint, notices {SPANS}, score double").withColumnRenamed("_id", id_col)


def listed(notices: Column) -> Column:
    """label:first word:last word:edits of each notice, comma-joined."""
    each = lambda s: F.concat_ws(":", s["label"], *(s[k].cast("string") for k in ("first_word", "last_word", "edits")))
    return F.array_join(F.transform(notices, each), ",")

import random
import re
import time

import pytest

from plumbline.llm import licenses as L

from .texts import EDGE, prose


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(text):
    w = words(text)
    hits = sorted((i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), hits


TEXTS = [
    "Released under the MIT License.", "GNU General\nPublic-License v3; gnu general public license", "cc-by 4.0 and CC BY", "xcc by ccby mit licenses", "The Apache License, Version 2.0 É mit license", "mit LICENSE apache license cc by",
]


@pytest.mark.parametrize("text", TEXTS)
def test_phrases(text):
    found, score = L.find(L.words_of(text))
    n, hits = brute(text)
    assert len(L.words_of(text)) == n and sorted((f["first_word"], f["label"]) for f in found if f["base"]) == hits
    assert (score == 1.0) == bool(hits) or score < 1


def test_notices_are_found_within_their_edits():
    g = random.Random(2)
    for notice, label in L.NOTICES.items():
        for edits in {0, 1, L.edit_budget(notice)}:
            damaged = list(notice)
            for k in g.sample(range(len(damaged)), edits):
                damaged[k] = "q"
            body = prose(g, 20) + "".join(damaged).split(" ") + prose(g, 20)
            found, score = L.find(body)
            mine = [f for f in found if not f["base"] and f["label"] == label]
            assert mine and abs(mine[0]["first_word"] - 20) <= 1 and score >= 1 - edits / len(notice) - 1e-9, (notice, edits)


def within(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def test_fuzzy_search_like_brute_force():
    """A notice is found if and only if some stretch of the text is within its edits, by trying all stretches."""
    g = random.Random(4)
    names = [n for n in L.NOTICES if len(n) < 40]
    for _ in range(60):
        notice = g.choice(names)
        damaged = list(notice)
        for _ in range(g.randint(0, L.edit_budget(notice) + 2)):
            k = g.randrange(len(damaged))
            damaged[k : k + 1] = g.choice(([], ["q"], ["q", damaged[k]]))
        text = " ".join("".join([*"ka lo ", *damaged, *" mi"]).split())
        e = L.edit_budget(notice)
        sizes = range(max(1, len(notice) - e), len(notice) + e + 1)
        there = any(within(notice, text[s : s + n], e) for s in range(len(text)) for n in sizes if s + n <= len(text))
        hits = [f for f in L.fuzzy(text) if L.NOTICES[f[0]] == L.NOTICES[notice]]
        rival = [f for f in L.fuzzy(text) if f not in hits]
        assert bool(hits) == there or (there and rival), (notice, text)
        for found, s, z, edits in hits:
            assert within(found, text[s:z], edits + 2)


def test_damaged_notices_close_together_are_all_found():
    """Two to six notices within their edits, with nought to three short words between them: each has a place of its own."""
    assert len(L.fuzzy("released under the mit licence released under the mit license")) == 2
    g = random.Random(8)
    for notice in [n for n in L.NOTICES if len(n) >= 19]:
        for gap in range(4):
            parts, spans, at = [], [], 0
            for _ in range(g.randint(2, 6)):
                damaged = list(notice)
                inner = [k for k in range(3, len(damaged) - 3) if damaged[k] != " "]
                for k in g.sample(inner, g.randint(0, L.edit_budget(notice))):
                    damaged[k] = "q"
                between = "".join(f"{g.choice(('zu', 'ka', 'x'))} " for _ in range(gap))
                spans.append((at, at + len(notice)))
                parts.append("".join(damaged) + " " + between)
                at += len(parts[-1])
            hits = [(s, z) for found, s, z, _ in L.fuzzy("".join(parts).strip()) if found == notice]
            assert len(hits) == len(spans), (notice, gap, parts)
            assert all(abs(s - a) <= 3 and abs(z - b) <= 3 for (s, z), (a, b) in zip(hits, spans)), (notice, gap, parts)


def test_the_closest_of_rival_notices_counts():
    for text, label in (("spdx license identifier lgpl 2 1", "lgpl"), ("spdx license identifier gpl 2 0", "gpl"), ("spdx license identifier agpl 3 0", "agpl")):
        assert {f["label"] for f in L.find(text.split())[0]} == {label}


@pytest.mark.parametrize("unit", ["mit license ", "all rights reserved ", "all rights ", "licensed under ", "cc by ", "x ", "released under the mit license ", "all rights reserve ", "released under the mit licence "])
def test_time_is_linear(unit):
    n = 60_000 // len(unit)
    began = time.process_time()
    found, _ = L.find(L.words_of(unit * n))
    assert time.process_time() - began < 4


def test_prose_has_none():
    g = random.Random(1)
    assert L.find(prose(g, 2000)) == ([], 0.0)
    assert L.find("all rights were observed and the software is free to any person".split())[0] == []


def test_table(frame):
    texts = [*TEXTS, *EDGE]
    rows = L.find_licenses(frame([*enumerate(texts), (None, "mit license"), (0, texts[0])])).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            n, hits = brute(texts[r["doc_id"]])
            assert r["n_words"] == n and sorted((f["first_word"], f["label"]) for f in r["notices"] if f["base"]) == hits
            assert 0 <= r["score"] <= 1
    assert L.find_licenses(frame([])).count() == 0
    assert L.find_licenses(frame([(1, "cc by", 3, "x")], ", n_words int, score string")).collect()[0]["n_words"] == 2

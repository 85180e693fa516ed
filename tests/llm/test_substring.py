import random
import re
from collections import Counter

import pytest

from plumbline.llm import common, substring
from plumbline.llm.substring import remove_repeats

from .texts import EDGE, edited, prose


def brute(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[s : s + length]) for w in words for s in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, d in zip(w, gone) if not d)))
    return out


@pytest.fixture(scope="module")
def texts():
    g = random.Random(2)
    passages = [prose(g, n) for n in (34, 35, 36, 60, 150)]
    out = []
    for _ in range(60):
        w = prose(g, g.randint(0, 200))
        for p in g.sample(passages, g.randint(0, 3)):
            k = g.randint(0, len(w))
            w[k:k] = p
        out.append(w)
    out += [edited(g, out[0] + passages[4], 4), out[3] + out[3], ["same"] * 100, ["same"] * 34, ["x", "y"] * 40, list(out[7]), list(out[7])]
    joined = [g.choice((" ", "\n", "  ", "\t")).join(w) for w in out]
    return joined + [" ".join(["nb"] * 40), "  wide " * 40] + EDGE


@pytest.mark.parametrize(("length", "anchor"), [(35, 20), (10, 10), (12, 1)])
def test_like_brute_force(frame, texts, length, anchor):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(frame(texts), length=length, anchor=anchor).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_hot_anchors(frame, texts, monkeypatch):
    monkeypatch.setattr(substring, "HOT_ANCHOR", 3)
    test_like_brute_force(frame, texts, 35, 20)


def test_hot_keys_are_split(frame, texts, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    test_like_brute_force(frame, texts, 35, 20)


def test_spans_are_the_removed_words(frame, texts):
    for r in remove_repeats(frame(texts)).collect():
        spans = list(zip(r["repeats"][::2], r["repeats"][1::2]))
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_rows_are_told_apart_by_text_alone(frame):
    p = " ".join(f"w{i}" for i in range(40))
    got = remove_repeats(frame([(None, p), (5, p + " end"), (5, "other " * 10), (None, None)])).collect()
    assert sorted(r["kept_text"] for r in got) == ["", "", "end", "other " * 9 + "other"]
    assert remove_repeats(frame([])).count() == 0
    assert remove_repeats(frame([(1, p, "x", 2)], ", _key string, repeats int")).collect()[0]["n_removed"] == 0

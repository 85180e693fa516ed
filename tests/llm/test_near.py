import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import near
from plumbline.llm.common import Steps, WordHashes

from .texts import EDGE, edited, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a, b):
    a, b = near.words_of(a), near.words_of(b)
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def brute_classes(rows):
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(rows):
        for j, b in rows[:p]:
            if near.words_of(a) == near.words_of(b) or similarity(a, b) >= 0.8 - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def rows():
    g = random.Random(4)
    out = []
    for _ in range(25):
        w = prose(g, g.randint(20, 120))
        out += [edited(g, w, g.randint(0, 5)) for _ in range(g.randint(1, 5))]
    half = out[0][len(out[0]) // 2 :] + out[0][: len(out[0]) // 2]
    texts = [" ".join(w) for w in [*out, half, ["rep"] * 60, ["rep"] * 50, ["rep"] * 58]] + [t or "" for t in EDGE]
    g.shuffle(texts)
    return list(enumerate(texts))


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30), st.integers(0, 25))
def test_banded_distance_is_that_of_a_full_alignment(a, b, most):
    want = distance(a, b)
    assert near.banded_distance(a, b, most) == (want if want <= most else None)


def test_similarity_is_that_of_a_full_alignment(rows):
    for i in range(0, len(rows), 3):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            assert near.similar(near.words_of(a), near.words_of(b)) == (similarity(a, b) >= 0.8 - 1e-9)


def test_word_counts_never_rule_out_similar_texts(rows):
    hashes = WordHashes()
    h = [hashes.array(near.words_of(t)) for _, t in rows]
    counts, n = np.array([near.counts_of(x) for x in h]).astype(np.int16), np.array(list(map(len, h)))
    for i in range(0, len(rows), 2):
        can = near.can_be_similar(counts[i], n[i], counts, n)
        assert all(can[j] for j in range(len(rows)) if near.similar(h[i].tolist(), h[j].tolist()))
    many = np.minimum(np.bincount([1] * 300, minlength=near.COUNTS), 255).astype(np.int16)
    assert near.can_be_similar(many, 300, many[None, :], np.array([290])).all()


def test_groups_lose_no_similar_pair(rows):
    hashes, g = WordHashes(), random.Random(2)
    h = [hashes.array(near.words_of(t)) for _, t in rows if near.words_of(t)]
    h += [np.concatenate([x, np.full(700, x[0])]) for x in h[:10]]  # counts beyond 255
    counts, n, roots = np.array([near.counts_of(x) for x in h]).astype(np.int16), np.array(list(map(len, h))), [g.randint(0, 9) for _ in h]
    got = {(min(i, j), max(i, j)) for i, j in zip(*near.pairs_in_group(roots, n, counts, 7), strict=True)}
    assert all(roots[i] != roots[j] for i, j in got)
    want = {(i, j) for j in range(len(h)) for i in range(j) if roots[i] != roots[j] and near.similar(h[i].tolist(), h[j].tolist())}
    assert want and want <= got and len(got) < len(want) + len(h) * len(h) // 20


def test_like_brute_force(frame, rows):
    assert classes(near.near_duplicates(frame(rows))) == brute_classes(rows)


def clustered(seed=8):
    """Near copies of three texts, and texts that share a passage with them and with each other."""
    g = random.Random(seed)
    base = [prose(g, 80) for _ in range(3)]
    out = [edited(g, g.choice(base), g.randint(0, 12)) for _ in range(60)]
    shared = prose(g, 30)
    own = [shared + prose(g, 20) for _ in range(12)]
    out += own + [edited(g, w, g.randint(1, 9)) for w in own]
    g.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_bucket_size_decides_no_link(frame, monkeypatch):
    """Pivots, pairs, rare words and blocks: whatever the limits, the classes are those of brute force."""
    rows = clustered()
    want = brute_classes(rows)
    for group, block in ((2048, 512), (3, 4)):
        monkeypatch.setattr(near, "GROUP", group)
        monkeypatch.setattr(near, "MEMBERS", group)
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "CHUNK", block)
        assert classes(near.near_duplicates(frame(rows))) == want


def unlike_in_every_band(g):
    """Three texts any two of which share one band and no other, the first two of similarity 0.8 or more."""
    hashes = WordHashes()
    while True:
        w = prose(g, 60)
        texts = [edited(g, w, g.randint(4, 9)) for _ in range(150)]
        bands = [set(near.order_minhash(near.kmers(hashes.array(t)))) for t in texts]
        once = {(i, j): min(bands[i] & bands[j]) for i in range(150) for j in range(i) if len(bands[i] & bands[j]) == 1}
        for (i, j), k in once.items():
            if near.similar(texts[i], texts[j]):
                for m in range(j):
                    if once.get((i, m)) == once.get((j, m)) == k:
                        return [" ".join(texts[n]) for n in (i, j, m)]


def test_one_shared_band_in_a_large_bucket(frame, monkeypatch):
    rows = list(enumerate(unlike_in_every_band(random.Random(3))))
    monkeypatch.setattr(near, "GROUP", 2)
    got = classes(near.near_duplicates(frame(rows)))
    assert got == brute_classes(rows) and got[0] == got[1]


def test_group_of_near_copies_is_one_class(frame):
    """2,000 copies with 1 to 4 of 60 words replaced, among other texts: one class, and no other document in it."""
    g = random.Random(5)
    w = prose(g, 60)
    rows = [(i, " ".join(edited(g, w, g.randint(1, 4)))) for i in range(2000)]
    rows += [(i, " ".join(prose(g, 60))) for i in range(2000, 2500)]
    got = classes(near.near_duplicates(frame(rows)))
    assert {got[i] for i in range(2000)} == {0} and all(got[i] == i for i in range(2000, 2500))


@pytest.mark.parametrize("n", [20, 40, 100])
def test_recall_of_edits(n):
    """Of pairs with 1, 2 or 3 words replaced, and of those with a fifth of them replaced, 0.95 or more share a band."""
    g = random.Random(12)
    hashes = WordHashes()

    def lost(edits):
        w = prose(g, n)
        v = list(w)
        for i in g.sample(range(n), edits):
            v[i] = "changed" + str(g.randrange(10**9))
        a, b = (set(near.order_minhash(near.kmers(hashes.array(t)))) for t in (w, v))
        return not a & b

    for edits in (1, 2, 3, n // 5):
        assert sum(lost(edits) for _ in range(400)) <= 20


def test_order_counts(frame):
    g = random.Random(9)
    w = prose(g, 100)
    got = classes(near.near_duplicates(frame([" ".join(w), " ".join(w[50:] + w[:50]), " ".join(w[:99])])))
    assert got[0] == got[2] != got[1]


def test_one_row_of_each_class_is_kept(frame, rows):
    got = near.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got})
    sizes = {}
    for r in got:
        sizes[r["class_id"]] = sizes.get(r["class_id"], 0) + 1
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)


def test_nulls_repeats_empty_and_clashes(frame):
    t = "a b c d e f g h"
    got = near.near_duplicates(frame([(3, t), (3, t), (None, t), (None, "x y z q r s"), (7, None), (9, "")])).collect()
    by = sorted(((r["doc_id"], r["class_id"]) for r in got), key=str)
    assert by == sorted([(3, 3), (3, 3), (None, 3), (None, None), (7, 7), (9, 7)], key=str)
    assert near.near_duplicates(frame([])).count() == 0
    assert near.near_duplicates(frame([(1, "q", 2, 3)], ", class_id int, _bands int")).collect()[0]["class_id"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    g = random.Random(seed)
    pairs = [(g.randrange(60), g.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    with Steps(spark) as steps:
        got = near.components(steps, spark.createDataFrame(pairs, "_a bigint, _b bigint")).collect()
    assert len(got) == len({r["_id"] for r in got})
    got = {r["_id"]: r["_root"] for r in got}
    root = {i: i for p in pairs for i in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in root.items() if sum(x == r for x in root.values()) > 1}


def test_many_copies_of_words_are_one_node(frame):
    rows = [(i, "The quick BROWN fox, jumps over it" if i % 2 else "the quick brown fox jumps over it!") for i in range(500)]
    got = near.near_duplicates(frame(rows)).agg(F.count_distinct("class_id"), F.max("class_size")).collect()[0]
    assert tuple(got) == (1, 500)

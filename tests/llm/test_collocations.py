import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import collocations
from plumbline.llm.collocations import keys_of, mine_collocations, score_of, tokens

from .texts import EDGE, VOCAB

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, top, covered=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in phrases.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], score))
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n[lang], score))
    return sorted(out)


def result(df, **more):
    out = mine_collocations(df, **more)
    assert tuple(out.columns) == COLUMNS
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture(scope="module")
def rows():
    g = random.Random(3)
    stock = [["in", "the", "same", "way"], ["kara", "LOdes"], ["as", "well", "as"], ["new", "york", "city", "hall"], ["é", "ñandú"]]
    out = []
    for _ in range(160):
        words = []
        for _ in range(g.randint(0, 40)):
            words += g.choice(stock)[: g.choice((2, 3, 4, 4))] if g.random() < 0.3 else [g.choice(VOCAB[:14]) + g.choice(("", "", "", ",", ".", "\n", "\t", "\x0b"))]
        out.append((" ".join(words), g.choice(("en", "en", "en", "de", None, "und", ""))))
    return out + [(t, "en") for t in EDGE] + [("kara lodes " * 400, "de"), ("x" * 50_000 + " y", "de")]


@pytest.mark.parametrize(("least", "top"), [(4, 2000), (4, 5), (8, 1), (3, 40)])
def test_like_brute_force(spark, rows, least, top):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert result(df, least=least, top=top) == brute(rows, least, top)


def test_small_sums_and_full_bits_lose_nothing(spark, rows, monkeypatch):
    for name in ("SLOTS", "SLOTS_A_ROW"):
        monkeypatch.setattr(collocations, name, 8)
    monkeypatch.setattr(collocations, "FLUSH", 50)
    assert result(spark.createDataFrame(rows, "text string, lang string"), least=4, top=10) == brute(rows, 4, 10)


def test_not_all_prefixes_are_grown(spark, rows, monkeypatch):
    """The bound settles the best phrases before everything has grown."""
    asked = []
    whole = collocations.bits_of
    monkeypatch.setattr(collocations, "bits_of", lambda steps, p: asked.append(p.count()) or whole(steps, p))
    df = spark.createDataFrame(rows, "text string, lang string")
    result(df, least=3, top=1)
    few, asked[:] = sum(asked[2:]), []
    result(df, least=3, top=2000)
    assert few < sum(asked[2:]) / 2


def test_ties_clashes_nulls_and_empty_tables(spark):
    rows = [("b a. d c! b a; d c", "x")] * 20 + [(None, None), ("", None), (None, "x")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, phrase int, _1 int, score int")
    assert [r[:4] for r in result(df, least=30, top=1)] == [("x", 1, "b a", 40)]
    assert [r[2] for r in result(df, least=40)] == ["b a", "d c"]
    assert result(df, least=41) == []
    assert result(df.limit(0)) == []


def test_scores_pass_64_bits(spark):
    a, l, r = 9_000_000_000_000_001, 9_100_000_000_000_000, 9_000_000_000_000_007
    got = spark.range(1).select(score_of(F.lit(a), F.lit(l) + F.lit(r))).first()[0]
    assert got == 2_000_000 * a // (l + r)


def test_tokens():
    assert tokens("A\tb  C,d\r\ne f É") == [w.encode() for w in ["a", "b", "c", ".", "d", ".", ".", "e f", "É"]]
    one, two = np.array([1, 2], np.uint64), np.array([2, 1], np.uint64)
    assert len({*keys_of("x", [one, two]).tolist(), *keys_of("y", [one, two]).tolist(), *keys_of("x", [one]).tolist()}) == 6


def test_hashes_are_counted_in_few_bytes():
    """Four bytes for each that occurs once in a scan; before, each was a row with its count."""
    import pyarrow as pa

    g = np.random.Generator(np.random.PCG64(4))
    keys = g.integers(0, 1 << 64, 200_000, np.uint64, endpoint=False)
    parts = [keys[:150_000], np.concatenate([keys[100_000:], keys[:3_000], keys[:3_000]]), keys[:1_000], keys[:0]]
    rows = pa.concat_tables([pa.Table.from_batches([collocations.packed("en", [x])]) for x in parts])
    assert len(rows) <= 3 * 2048
    assert sum(len(r["_one"]) + len(r["_more"]) + len(r["_times"]) for r in rows.to_pylist()) == sum(4 * np.count_nonzero(n == 1) + 8 * np.count_nonzero(n > 1) for n in (np.unique(x, return_counts=True)[1] for x in parts))
    rows = rows.sort_by("_key").combine_chunks()
    mask = np.uint64((2048 << 32) - 1)
    for least, wanted in ((1, keys), (2, np.concatenate([keys[:3_000], keys[100_000:150_000]])), (3, keys[:3_000]), (4, keys[:1_000])):
        got = pa.Table.from_batches(list(collocations.frequent_hashes(least)(iter(rows.to_batches(max_chunksize=100)))))["k"].to_numpy()
        assert sorted(got.tolist()) == sorted((wanted & mask).tolist())

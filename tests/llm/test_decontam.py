import random

import pytest

from plumbline.llm import decontam
from plumbline.llm.decontam import align, build, contaminated, edit_budget, normalise, search, source_span

from .texts import EDGE, prose


def best_place(item, text):
    """Least edits of item against any part of text: plain dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def garble(g, text, edits):
    out = list(text)
    for _ in range(edits):
        k = g.randrange(len(out))
        out[k : k + 1] = g.choice(([], ["q", out[k]], ["q"]))
    return "".join(out)


@pytest.fixture(scope="module")
def items():
    g = random.Random(5)
    return [(i, " ".join(prose(g, n))) for i, n in enumerate((20, 25, 40, 12, 60, 30))]


def test_search_like_brute_force(items):
    g = random.Random(6)
    index = build([(i, normalise(t)) for i, t in items])
    found = 0
    for n in range(120):
        i, item = g.choice(items)
        budget = edit_budget(len(item))
        edits = g.choice((0, 1, budget // 2, budget, budget + 1, 3 * budget))
        body = normalise(" ".join(prose(g, g.randint(0, 60))) + " " + garble(g, item, edits) + " " + " ".join(prose(g, g.randint(0, 60))))
        got = {k: d for k, _, _, d in search(index, body)}
        for k, t in items:
            want = best_place(normalise(t), body)
            if want <= edit_budget(len(t)):
                assert got.get(k) == want, (n, k, want)
                found += 1
            else:
                assert k not in got, (n, k, want)
    assert found > 40


def test_items_at_the_ends_and_twice(items):
    index = build([(i, normalise(t)) for i, t in items])
    item = normalise(items[2][1])
    assert search(index, item) == [(2, 0, len(item), 0)]
    both = f"{item} zzz {item}"
    assert search(index, both) == [(2, 0, len(item), 0), (2, len(item) + 5, len(both), 0)]
    cut = item[3:]
    assert [x[0] for x in search(index, cut)] == [2]
    assert search(index, item[: len(item) // 2]) == []


def test_alignment_stays_in_the_text():
    assert align("abcdef", "abcdef", 0, 0, 1) == (0, 6, 0)
    assert align("abcdefgh", "xbcdefgh", 0, 0, 2)[2] == 1
    assert align("abc", "", 0, 0, 1) is None


def test_spans_in_the_source(frame, spark, items):
    text = f"Ünd so, «start» {items[0][1].upper().replace(' ', ',  ')}!! end İx"
    docs = frame([(7, text), (8, "clean text " * 50), (9, None)])
    got = contaminated(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(7, 0, 0)]
    assert normalise(text[got[0]["start"] : got[0]["end"]]) == items[0][1]
    assert source_span("One two, three", 4, 7) == (4, 7)


def test_slices_give_the_same(items, monkeypatch):
    g = random.Random(3)
    shared = " ".join(prose(g, 8))
    index = decontam.build([(i, normalise(f"{shared} {t}")) for i, t in items])
    texts = [normalise(" ".join([*prose(g, 20), shared, t, *prose(g, 5), shared])) for _, t in items]
    want = [sorted(decontam.regions(index, t)) for t in texts]
    assert any(want)
    for n in (1, 7, 100):
        monkeypatch.setattr(decontam, "ENTRIES", n)
        assert [sorted(decontam.regions(index, t)) for t in texts] == want


def test_blocks_give_the_same(frame, spark, items):
    g = random.Random(7)
    docs = frame([" ".join([*prose(g, 20), t, *prose(g, 20)]) for _, t in items] + EDGE)
    bench = spark.createDataFrame([*items, (98, "short one"), (99, None), (97, "!!")], "item_id int, text string")
    whole, cut = (sorted(map(tuple, contaminated(docs, bench, block_chars=n).collect())) for n in (10**6, 150))
    assert whole == cut and {(d, i) for d, i, *_ in whole} >= {(k, k) for k in range(len(items))}


def test_short_items_and_edges(frame, spark):
    bench = spark.createDataFrame([(1, "ab cd"), (2, ""), (3, None), (1, "ab cd")], "item_id int, text string")
    got = contaminated(frame([(1, "x AB, cd y"), (2, "xab cd"), (None, "ab cd"), (1, "x AB, cd y")]), bench).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["end"]) for r in got) == sorted([("1", 2, 8), ("None", 0, 5), ("1", 2, 8)] * 2)
    assert contaminated(frame([]), bench).count() == 0 and contaminated(frame(["ab cd"]), bench.limit(0)).count() == 0
    assert decontam.edit_budget(0) == 0
    clash = contaminated(frame([(1, "x AB, cd y", 1, 2, "t")], ", start int, edits int, _text string"), bench.limit(1)).collect()
    assert [(r["doc_id"], r["start"], r["edits"]) for r in clash] == [(1, 2, 0)]

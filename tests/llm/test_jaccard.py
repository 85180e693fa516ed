import random

import numpy as np
import pytest

from plumbline.llm import jaccard, near
from plumbline.llm.common import WordHashes
from plumbline.llm.jaccard import ENDS, alike, jaccard_components, plan, shingles, signatures

from .texts import EDGE, edited, prose


def brute_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(6)
    out = []
    for n in (3, 5, 6, 8, 9, 12, 20, 40, 90, 200, 500):
        for _ in range(4):
            body = prose(g, n)
            out += [" ".join(edited(g, body, g.randint(0, max(1, n // 25)))) for _ in range(8)] + [" ".join(body).upper()]
    passage = prose(g, 60)
    out += [" ".join(passage + prose(g, g.randint(0, 30))) for _ in range(40)]
    return list(enumerate(out + EDGE))


def test_like_brute_force(frame, rows):
    assert result(frame(rows)) == brute(rows)


@pytest.mark.parametrize(("group", "block"), [(2, 4), (6, 3)])
def test_large_buckets_lose_nothing(frame, rows, monkeypatch, group, block):
    for name, size in (("GROUP", group), ("MEMBERS", 2 * group), ("BLOCK", block), ("CHUNK", 2)):
        monkeypatch.setattr(near, name, size)
    some = rows[::3]
    assert result(frame(some)) == brute(some)


@pytest.mark.parametrize("dealings", [1, 2, 12])
def test_partners_share_a_signature(monkeypatch, dealings):
    """All pairs at the very threshold, sizes 1 to 300, in bands and across them; with one dealing, empty partitions sign."""
    monkeypatch.setattr(jaccard, "DEALINGS", dealings)
    monkeypatch.setattr(jaccard, "_SALTS", jaccard._SALTS[:dealings])
    g = np.random.Generator(np.random.PCG64(8))
    linked = 0
    for _ in range(4000):
        s = int(g.integers(1, 300)) if g.random() < 0.3 else int(g.integers(1, 30))
        t = int(g.integers(s, s * 100 // 80 + 1))
        common = -(-8 * (s + t) // 18)
        x = g.integers(0, 1 << 63, s + t - common, np.uint64)
        a, b = np.unique(x[:s]), np.unique(x[s - common :])
        if common <= s and alike(a.tolist(), b.tolist()):
            linked += 1
            assert len(a) != len(b) or len(a) == common or set(signatures(a).tolist()) & set(signatures(b).tolist())
            assert len(x) == common or set(signatures(a).tolist()) & set(signatures(b).tolist()), (s, t)
    assert linked > 1500


def test_bands_hold_all_partners():
    band = lambda n: next(k for k, e in enumerate(ENDS) if n <= e)
    for n in range(1, 3000):
        assert band(n * 100 // 80) - band(n) in (0, 1)
    assert plan(0)[0] == 0 and max(plan(k)[0] for k in range(60)) > 1000


def test_sets_without_much_in_common_share_few_signatures():
    g = np.random.Generator(np.random.PCG64(9))
    shared = 0
    for _ in range(300):
        x = g.integers(0, 1 << 63, 190, np.uint64)
        a, b = np.unique(x[:100]), np.unique(x[90:])
        shared += bool(set(signatures(a).tolist()) & set(signatures(b).tolist()))
    assert shared < 60


def test_shingles_are_distinct_five_word_runs():
    for t in EDGE + ["a b c d e f a b c d e f", "A\tb\x0bc d e", "a b c d", "d c b a", "x " * 9]:
        assert len(shingles(t or "", WordHashes())) == len(brute_set(t))


def test_null_ids_repeated_rows_clashes_and_empty_tables(frame):
    t = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, t), (5, t), (None, t), (None, "q r s t u v"), (7, "q r s t u v w x"), (None, "Z y"), (3, ""), (None, None), (9, "z Y"), (9, t)]
    assert result(frame(rows)) == brute(rows)
    df = frame([(1, "a b", 2, 3), (2, "A B", 2, 3)], ", component_id int, _id int")
    assert [r["component_id"] for r in jaccard_components(df).collect()] == [1, 1]
    assert jaccard_components(df.limit(0)).count() == 0


def test_one_very_long_text(frame):
    g = random.Random(2)
    body = prose(g, 40_000)
    rows = [(0, " ".join(body)), (1, " ".join(body[:36_000])), (2, " ".join(body[:20_000])), (3, " ".join(edited(g, body, 300)))]
    assert result(frame(rows)) == brute(rows)


def test_sketches_rule_out_nothing_that_is_alike():
    import pyarrow as pa

    g = np.random.Generator(np.random.PCG64(3))
    pool = [g.integers(0, 1 << 63, n, np.uint64) for n in (3, 9, 60, 64, 70, 400)]
    sets = []
    for x in pool:
        for _ in range(12):
            keep = x[g.random(len(x)) > g.choice((0.0, 0.05, 0.15, 0.3))]
            sets.append(np.unique(np.concatenate([keep, g.integers(0, 1 << 63, int(g.integers(0, 1 + len(x) // 8)), np.uint64)])))
    sets = [x for x in sets if len(x)]
    sketches, n, roots = pa.array([jaccard.sketch_of(x) for x in sets], pa.binary()), np.array([len(x) for x in sets]), [int(g.integers(0, 20)) for _ in sets]
    left, right = jaccard.set_pairs(roots, n, sketches)
    got = {(min(i, j), max(i, j)) for i, j in zip(left.tolist(), right.tolist(), strict=True)}
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and alike(sets[i].tolist(), sets[j].tolist())}
    assert linked <= got and all(roots[i] != roots[j] for i, j in got) and len(got) == len(left)
    assert len(got) < 2 * len(linked) and len(linked) > 50
    for i, j in linked:
        assert jaccard.can_be(sketches.take([i]), n[[i]], sketches.take([j]), n[[j]]).all()


def test_signatures_are_shuffled_in_few_bytes():
    """A row for each text and bucket, six bytes for each signature; before, each was a row of its own."""
    import pyarrow as pa

    g = random.Random(11)
    texts = [" ".join(f"w{g.randrange(10_000)}" for _ in range(300)) for _ in range(500)]
    n = sum(len(signatures(shingles(t, WordHashes()))) for t in texts)
    batch = pa.RecordBatch.from_pydict({"_text": texts, "_t": [str(k).encode() for k in range(len(texts))]})
    rows = pa.Table.from_batches(list(jaccard.signed(iter([batch]))))
    assert len(rows) <= 500 + 2048 < n / 20
    assert sum(len(r["_sigs"]) + len(r["_at"]) for r in rows.to_pylist() if r["_sigs"]) == 6 * n


def test_packed_signatures_meet_like_whole_ones(monkeypatch):
    """Texts that share a signature all meet its pivot, whichever flush and batch they are in."""
    import pyarrow as pa

    g = random.Random(12)
    body = prose(g, 40)
    texts = [" ".join(edited(g, body, k % 4)) for k in range(60)] + ["", "a b"] + [" ".join(prose(g, 30)) for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"_text": texts, "_t": [str(k).encode() for k in range(len(texts))]})
    for flush in (1, 1_000, 2_000_000):
        monkeypatch.setattr(jaccard, "FLUSH", flush)
        dealt = pa.Table.from_batches(list(jaccard.signed(iter([batch])))).sort_by("_key").combine_chunks()
        found = pa.Table.from_batches(list(jaccard.met_in_buckets(iter(dealt.to_batches(max_chunksize=7))))).to_pylist()
        name = {r["_d"]: r["_id"] for r in found if r["_p"] is None}
        assert sorted(r["_t"] for r in found if r["_p"] is None) == sorted(batch.column("_t").to_pylist())
        root = {r["_d"]: set() for r in found if r["_p"] is None}
        for r in found:
            if r["_p"] is not None:
                root[r["_d"]].add(r["_p"])
        sets = {k: (name_, set(signatures(shingles(t, WordHashes())).tolist())) for k, t in enumerate(texts) for name_ in [jaccard.name_of(shingles(t, WordHashes()))]}
        ups = {}
        for d, p in root.items():
            ups.setdefault(name[d], set()).update(p)
        for a, x in sets.values():
            for b, y in sets.values():
                assert a == b or not x & y or ups[a] & ups[b]


def test_sketches_take_bits_and_rule_out_what_is_near():
    """At most half a byte a shingle; sets of similarity 0.7 do not pass. Before, a byte or two a shingle."""
    import pyarrow as pa

    g = np.random.Generator(np.random.PCG64(4))
    for n in (100, 256, 257, 700, 2048):
        assert len(jaccard.sketch_of(g.integers(0, 1 << 63, n, np.uint64))) <= n / 2
    passed = 0
    for _ in range(100):
        x = g.integers(0, 1 << 63, 1300, np.uint64)
        a, b = x[:1105], x[195:]  # 910 of 1,300 in common
        one, other = (pa.array([jaccard.sketch_of(y)], pa.binary()) for y in (a, b))
        passed += bool(jaccard.can_be(one, np.array([len(a)]), other, np.array([len(b)])).any())
    assert passed < 5
    small, large = g.integers(0, 1 << 63, 512, np.uint64), g.integers(0, 1 << 63, 90, np.uint64)
    bits = lambda y: jaccard.bits_of(jaccard.sketch_of(y))
    assert jaccard.differing(bits(small), bits(np.concatenate([small, large]))) <= 90 and len(bits(small)) < len(bits(np.concatenate([small, large])))


def test_only_compared_sets_are_listed(frame, monkeypatch):
    """Texts with a passage in common share signatures; their shingles are not written, only sketches. Before, all of them were."""
    g = random.Random(13)
    passage, pair = prose(g, 60), prose(g, 200)
    texts = [" ".join(passage + [f"w{g.randrange(10_000)}" for _ in range(120)]) for _ in range(60)] + [" ".join(pair), " ".join(pair + ["end"])]
    rows, wide, known = [*enumerate(texts)], {}, jaccard.Steps.written

    def watched(self, df, label):
        out = known(self, df, label)
        if {"_x", "_c"} & set(out.columns):
            wide[label] = wide.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard.Steps, "written", watched)
    assert result(frame(rows)) == brute(rows)
    assert wide["sketches"] > 30 and wide["lists"] < 10

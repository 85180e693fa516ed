import hashlib
import math
import random
from collections import defaultdict

import pytest

from plumbline.llm import common, mixing
from plumbline.llm.mixing import bisect_exponent, mix_sources

from .texts import EDGE, prose


def h(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def brute(rows, max_repeats=2.0, block_tokens=200_000, seed=1, budget_ratio=None):
    docs = [(i, f"s:{s}" if s is not None else "", max(1, len((t or "").split()))) for i, t, s in rows]
    total, sums = sum(d[2] for d in docs), defaultdict(int)
    for _, s, n in docs:
        sums[s] += n
    p = {s: n / total for s, n in sums.items()}
    lo, hi = 0.0, 1.0
    for _ in range(30):
        a = (lo + hi) / 2
        z = sum(x**a for x in p.values())
        scale = z * max(p.values()) ** (1 - a) if budget_ratio is None else budget_ratio
        lo, hi = (a, hi) if scale * min(p.values()) ** (a - 1) / z > max_repeats * (1 + 1e-12) else (lo, a)
    a = round(hi, 6)
    z = sum(x**a for x in p.values())
    budget = total * (budget_ratio if budget_ratio is not None else max(x / x**a for x in p.values()) * z)
    out, blocks = {}, defaultdict(list)
    for i, s, n in docs:
        target = int(p[s] ** a / z * budget + 0.5)
        k = h(seed, "block", i) % math.ceil(sums[s] / block_tokens)
        blocks[s, k].append((i, n, target // sums[s], target % sums[s], target))
    for (s, k), members in blocks.items():
        held, before = sum(m[1] for m in members), 0
        for i, n, full, rest, target in sorted(members, key=lambda m: (h(seed, m[2], m[0]), m[0])):
            before += n
            more = rest > 0 and 2 * before - n <= 2 * math.floor(rest * held / sums[s])
            out[i] = (k, full + more, target)
    return a, out


@pytest.fixture(scope="module")
def rows():
    g = random.Random(5)
    return [(i, " ".join(prose(g, g.randint(1, 60))), g.choice(["big"] * 12 + ["mid"] * 3 + ["small", None])) for i in range(600)] + [(600 + i, t, "big") for i, t in enumerate(EDGE)]


@pytest.mark.parametrize(("repeats", "block", "ratio"), [(2.0, 200_000, None), (4.0, 300, None), (1.5, 1000, 0.7)])
def test_like_brute_force(frame, rows, repeats, block, ratio):
    a, want = brute(rows, repeats, block, budget_ratio=ratio)
    got = mix_sources(frame(rows, ", source string"), max_repeats=repeats, block_tokens=block, budget_ratio=ratio).collect()
    assert {r["exponent"] for r in got} == {a}
    assert {r["doc_id"]: (r["block_no"], r["copies"], r["budget_tokens"]) for r in got} == want


def test_more_sources_than_may_be_broadcast(frame, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    test_like_brute_force(frame, rows, 2.0, 200_000, None)


def test_the_null_source_is_like_no_other(frame):
    got = mix_sources(frame([(1, "a b", None), (2, "a b", "\u0000"), (3, "a b", "")], ", source string")).collect()
    assert {r["doc_id"]: r["source"] for r in got} == {1: None, 2: "\u0000", 3: ""} and all(r["budget_tokens"] == 2 for r in got)


def test_budgets_are_met_and_nothing_is_left_out(frame, rows):
    got = mix_sources(frame(rows, ", source string")).collect()
    assert len(got) == len(rows) and all(r["copies"] >= 1 for r in got)
    spent, budget, held = defaultdict(int), {}, defaultdict(int)
    for r in got:
        spent[r["source"]] += r["copies"] * r["n_tokens"]
        held[r["source"]] += r["n_tokens"]
        budget[r["source"]] = r["budget_tokens"]
        assert len(r["schedule"]) == r["copies"] and [x["epoch"] for x in r["schedule"]] == list(range(r["copies"]))
    assert all(abs(spent[s] - budget[s]) <= 3000 for s in spent)
    assert max(budget[s] / held[s] for s in held) <= 2.001 and sum({r["source"]: r["weight"] for r in got}.values()) == pytest.approx(1)


def test_entropy_target(spark):
    shares = [0.7, 0.2, 0.05, 0.05]
    totals = spark.createDataFrame([(s,) for s in shares], "share double")
    for target in (0.75, 0.9, 0.99):
        a = bisect_exponent(totals, target_entropy=target)
        w = [x**a for x in shares]
        w = [x / sum(w) for x in w]
        assert -sum(x * math.log(x) for x in w) / math.log(4) == pytest.approx(target, abs=1e-4)
    assert bisect_exponent(totals) == 1.0


def test_epochs_come_in_different_orders(frame):
    g = random.Random(1)
    rows = [(i, " ".join(prose(g, 5)), "big") for i in range(400)] + [(400 + i, " ".join(prose(g, 5)), "small") for i in range(60)]
    got = mix_sources(frame(rows, ", source string"), max_repeats=3.0, block_tokens=50).collect()
    orders = [[x[1] for x in sorted(((s["block_key"], s["doc_key"]), r["doc_id"]) for r in got for s in r["schedule"] if s["epoch"] == e)] for e in (0, 1)]
    both = set(orders[1])
    assert len(both) > 40 and [d for d in orders[0] if d in both] != orders[1]
    blocks = [r["block_no"] for r in sorted((r for r in got if r["source"] == "big"), key=lambda r: (r["schedule"][0]["block_key"], r["schedule"][0]["doc_key"]))]
    assert sum(a != b for a, b in zip(blocks, blocks[1:])) + 1 == len(set(blocks))


def test_edges(frame):
    assert mix_sources(frame([], ", source string")).count() == 0
    one = mix_sources(frame([(1, "a b", "s", 9), (1, "a b", "s", 9), (None, None, "s", 9)], ", source string, weight int")).collect()
    assert len(one) == 3 and all(r["weight"] == 1.0 and r["copies"] == 1 for r in one)


def test_no_python_in_the_plan(frame, rows):
    plan = mix_sources(frame(rows, ", source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

import random

import pytest

from plumbline.llm import common, exact
from plumbline.llm.exact import exact_dedup

from .texts import EDGE, prose


def brute(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return sorted((i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)])) for i, t in rows)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept").collect())


@pytest.fixture(scope="module")
def rows():
    g = random.Random(1)
    bodies = [" ".join(prose(g, g.randint(1, 120))) for _ in range(40)]
    out = [g.choice((str, str.upper, str.title))(g.choice(bodies)) + g.choice(("", "", ".")) for _ in range(300)]
    out += [b[:300] + "x" + b[300:] for b in bodies] + ["É" + "a" * 400, "é" + "a" * 400, "a" * 300 + "B", "a" * 300 + "b", "a" * 300 + "c"] + EDGE
    return list(enumerate(out))


def test_like_brute_force(frame, rows):
    assert result(exact_dedup(frame(rows))) == brute(rows)


def test_a_full_bit_table_loses_nothing(frame, rows, monkeypatch):
    monkeypatch.setattr(common, "SLOTS", 8)
    monkeypatch.setattr(common, "SLOTS_A_ROW", 8)
    assert result(exact_dedup(frame(rows))) == brute(rows)


def test_hot_groups_are_split(frame, rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert result(exact_dedup(frame(rows))) == brute(rows)
    assert exact.split_join is common.split_join


def test_repeated_rows_null_ids_and_empty_tables(frame):
    got = exact_dedup(frame([(1, "a"), (1, "a"), (None, "a"), (None, "z"), (2, "b")])).collect()
    by = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str)
    assert by == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 2, 1, True)], key=str)
    assert exact_dedup(frame([])).count() == 0


def test_clashing_columns(frame):
    df = frame([(1, "x", 5, "k"), (2, "X", 6, "l")], ", keep_id int, _text string")
    got = exact_dedup(df, carry=("_text",)).orderBy("doc_id").collect()
    assert [(r["keep_id"], r["_text"]) for r in got] == [(2, "k"), (2, "l")]


def test_no_python_in_the_plan(frame, rows):
    plan = exact_dedup(frame(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

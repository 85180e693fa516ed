import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives
from plumbline.llm.hard_negatives import LARGEST, bounds, chosen, exact_scores, mine_hard_negatives, unit

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, positives=5, negatives=5, least=80):
    taken = []
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(v is not None and math.isfinite(v) and math.isfinite(256 * v) for v in x):
            taken.append((i, [math.floor(256 * v) for v in x], label))
    out = []
    for a, (i, x, label) in enumerate(taken):
        if i % 10:
            continue
        scored = [(-max(-LARGEST - 1, min(LARGEST, sum(p * q for p, q in zip(x, y)))), j, same == label) for b, (j, y, same) in enumerate(taken) if b != a]
        for p, j, _ in sorted(s for s in scored if s[2])[:positives]:
            hard = sorted(s for s in scored if not s[2] and least * -p <= 100 * -s[0] <= 100 * -p)[:negatives]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(hard, 1)]
    return sorted(out)


def result(df, **more):
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


@pytest.fixture(scope="module")
def rows():
    g = np.random.Generator(np.random.PCG64(2))
    centres = g.normal(size=(5, 12))
    out = [(i, (centres[i % 5] + g.normal(size=12) * 0.6).astype(np.float32).astype(float).tolist(), int(g.integers(0, 4))) for i in range(400)]
    out += [(1000 + i, [float(v) for v in g.integers(-1, 2, 12) / 256], 2) for i in range(60)]  # many ties
    odd = [None, [], [0.0] * 12, [1.0, None], [math.nan] * 12, [math.inf] + [0.0] * 11, [1e306] * 12, [3.0], [1.0] * 30]
    return out + [(2000 + 10 * i, x, 1) for i, x in enumerate(odd)] + [(None, [1.0] * 12, 1), (3000, [1.0] * 12, None)] + out[:12]


@pytest.mark.parametrize("sizes", [(1024, 512, 16), (7, 5, 2)])
def test_like_brute_force(spark, rows, sizes, monkeypatch):
    for name, size in zip(("CELL", "BLOCK", "RUN"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == brute(rows) and len({r[0] for r in got}) > 40


def test_other_numbers_and_hot_labels(spark, rows, monkeypatch):
    from plumbline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert result(spark.createDataFrame(rows, SCHEMA), positives=2, negatives=9, least=50) == brute(rows, 2, 9, 50)


def test_large_components(spark):
    g = random.Random(4)
    rows = [(i, [g.choice((-1, 1)) * 10.0 ** g.choice((0, 3, 9, 14, 200)) for _ in range(3)], i % 2) for i in range(50)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_clashes_and_empty_tables(spark):
    rows = [(i, [1.0, i / 8], i % 2, 5, "x", None) for i in range(21)]
    df = spark.createDataFrame(rows, SCHEMA + ", _row int, _v string, rank void")
    assert result(df) == brute([r[:3] for r in rows])
    assert result(df.limit(0)) == []
    assert result(df.withColumn("embedding", F.lit(None).cast("array<double>"))) == []


def test_bounds_hold_and_tell_apart():
    g = np.random.Generator(np.random.PCG64(1))
    centres = g.normal(size=(4, 16))
    x = np.floor(256 * (centres[np.arange(200) % 4] + g.normal(size=(200, 16)) * 0.3))
    references = chosen(list(x[:50]), 8)
    angles, norms = np.arccos(np.clip(unit(x) @ references.T, -1, 1)), np.linalg.norm(x, axis=1)
    least, most = bounds(angles, norms, angles, norms)
    scores = x @ x.T
    assert (least <= scores).all() and (scores <= most).all()
    near = scores >= 0.9 * norms[:, None] * norms[None, :]
    assert (most < 0.9 * norms[:, None] * norms[None, :]).mean() > 0.5 > near.mean()


def test_only_overlapping_windows_are_scored(spark, rows, monkeypatch):
    """With bounds that exclude nothing, more is scored."""
    import pyarrow as pa

    from plumbline.llm.hard_negatives import Search

    g = np.random.Generator(np.random.PCG64(1))
    centres = g.normal(size=(4, 16))
    x = np.floor(256 * (centres[np.arange(200) % 4] + g.normal(size=(200, 16)) * 0.2))
    angles, norms = np.arccos(np.clip(unit(x) @ chosen(list(x[:50]), 8).T, -1, 1)), np.linalg.norm(x, axis=1)
    table = pa.table({"_row": list(range(200)), "_id": list(range(200)), "_label": ["a"] * 5 + ["b"] * 195, "_v": [v.tobytes() for v in x], "_norm": norms, "_angles": angles.tolist(), "_scores": pa.array([[int(norms[0] ** 2)]] * 200, pa.list_(pa.int64()))})
    scored = []
    monkeypatch.setattr(hard_negatives, "exact_scores", lambda q, r, n: scored.append(len(r)) or exact_scores(q, r, n))
    s = Search(table.slice(0, 1), False, 5, 80)
    s.look(table)
    assert 0 < sum(scored) < 100

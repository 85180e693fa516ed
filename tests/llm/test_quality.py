import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality as Q

from .texts import EDGE, prose


@pytest.fixture(scope="module")
def rows():
    g = random.Random(6)
    out = []
    for i in range(400):
        w = prose(g, g.randint(5, 80))
        bad = i % 5 == 0
        if bad:
            w = g.choice((lambda: [x + "&&&" for x in w], lambda: [x.upper() + "!!" for x in w], lambda: [x for x in w[:5] for _ in range(12)]))()
        out.append((i * 7, " ".join(w), 0 if bad else 1))
    return out


@pytest.fixture(scope="module")
def model(spark, frame, rows):
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    return Q.fit_quality(frame([(i, t) for i, t, _ in rows]), labels)


def out(x):
    return zlib.crc32(str(x).encode()) % 5 == 0


def test_held_out_accuracy(frame, rows, model):
    got = {r["doc_id"]: r for r in Q.with_quality(frame([(i, t) for i, t, _ in rows]), model).withColumn("out", Q.held_out("doc_id")).collect()}
    assert all(got[i]["out"] == out(i) for i, *_ in rows)
    held = [(got[i]["quality_score"] >= 0.3, y) for i, _, y in rows if out(i)]
    assert len(held) > 40 and sum(p == bool(y) for p, y in held) / len(held) >= 0.93
    assert all(0 <= r["quality_score"] <= 1 for r in got.values())


def test_held_out_labels_are_never_used(spark, frame, rows, model):
    flipped = spark.createDataFrame([(i, 1 - y if out(i) else y) for i, _, y in rows], "doc_id bigint, quality int")
    other = Q.fit_quality(frame([(i, t) for i, t, _ in rows]), flipped)
    assert np.array_equal(other.words, model.words) and other.temperature == model.temperature
    assert all(np.allclose(a, b) for a, b in zip(other.layers, model.layers))


def test_scores_depend_on_the_text_alone(frame, rows, model):
    t = rows[1][1]
    docs = frame([(1, t, "en", "s1"), (999, t, None, None)], ", lang string, source string")
    assert len({r["quality_score"] for r in Q.with_quality(docs, model).collect()}) == 1


def test_edge_texts(frame, model):
    got = Q.with_quality(frame([*enumerate(EDGE), (None, "x"), (0, "x")]), model).collect()
    assert len(got) == len(EDGE) + 2 and all(0 <= r["quality_score"] <= 1 for r in got)
    assert len({r["quality_score"] for r in got if r["text"] in (None, "")}) == 1
    assert Q.with_quality(frame([]), model).count() == 0
    clash = Q.with_quality(frame([(1, "x", 0.5, "t")], ", quality_score double, _text string"), model)
    assert clash.columns == ["doc_id", "text", "quality_score_in", "_text", "quality_score"] and clash.collect()[0]["quality_score_in"] == 0.5


def test_labels_of_one_class_or_none(spark, frame):
    docs = frame([(i, "some words") for i in range(30)])
    ones = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    assert Q.with_quality(docs, Q.fit_quality(docs, ones)).agg(F.min("quality_score")).collect()[0][0] > 0.9
    none = Q.fit_quality(docs, ones.limit(0))
    assert {r["quality_score"] for r in Q.with_quality(docs, none).collect()} == {0.5}


def test_sample_is_bounded(spark, frame, rows):
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id bigint, quality int")
    small = Q.fit_quality(frame([(i, t) for i, t, _ in rows]), labels, max_rows=60)
    assert small.layers is not None


def test_temperature_minimises_the_loss():
    g = np.random.Generator(np.random.PCG64(1))
    z = g.normal(0, 2, 4000)
    y = (g.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert Q.calibrate(3 * z, y) == pytest.approx(3, rel=0.15)


def plain_vectors(texts):
    """Random-indexing vectors by counting neighbours one by one."""
    index, buckets = Q.index_vectors().astype(np.float64), Q.Buckets()
    sums = index.copy()
    for text in texts:
        b = [buckets[w] >> 1 for w in Q.TOKEN.findall(text)] or [buckets[Q.EMPTY] >> 1]
        for i in range(len(b)):
            for j in range(len(b)):
                if i != j and abs(i - j) <= Q.NEIGHBOURS:
                    sums[b[i]] += index[b[j]]
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def plain_pooled(words, text):
    buckets = Q.Buckets()
    tokens = Q.TOKEN.findall(text)
    b = [buckets[w] >> 1 for w in tokens] or [buckets[Q.EMPTY] >> 1]
    x = sum(words[k] for k in b)
    x = x + sum(len(w) > 1 and w.isupper() for w in tokens) * words[buckets[Q.UPPER] >> 1]
    return (x + sum(p == q for p, q in zip(b, b[1:])) * words[buckets[Q.SAME] >> 1]) / len(b)


def test_scores_like_brute_force(frame, rows, model):
    """Vectors, pooling, network and temperature computed plainly give the model's scores."""
    words = plain_vectors([t for i, t, _ in rows if not out(i)])
    assert np.allclose(words, model.words, atol=1e-5)
    some = [*rows[:40], (1, "", 0), (2, "THE THE the &&& ___", 0)]
    got = {r["doc_id"]: r["quality_score"] for r in Q.with_quality(frame([(1000 + k, t) for k, (_, t, _) in enumerate(some)]), model).collect()}
    mean, scale, w1, b1, w2, b2 = model.layers
    for k, (_, t, _) in enumerate(some):
        z = (plain_pooled(model.words.astype(np.float64), t) - mean) / scale
        hidden = [max(0.0, sum(z[i] * w1[i, j] for i in range(len(z))) + b1[j]) for j in range(len(b1))]
        logit = (sum(h * w for h, w in zip(hidden, w2)) + b2) / model.temperature
        assert got[1000 + k] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-4)


def test_temperature_like_brute_force():
    g = np.random.Generator(np.random.PCG64(2))
    z, y = g.normal(0, 3, 300), (g.random(300) < 0.6).astype(float)
    loss = lambda t: -sum(np.log(1 / (1 + np.exp(-a / t)) if b else 1 - 1 / (1 + np.exp(-a / t))) for a, b in zip(z, y))
    best = Q.calibrate(z, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 101)))

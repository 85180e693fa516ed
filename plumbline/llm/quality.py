"""Quality classifier: random-indexing word vectors, pooled, then a two-layer numpy network.

Every word gets a sparse random index vector from its hash; its word vector is the sum of the
index vectors of its neighbours in the training sample. Words share a table of fixed size by
hash, so what is broadcast does not grow with the corpus. A document is the mean of its word
vectors. The network's probabilities are calibrated by one temperature on rows held back
from fitting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, arrow_texts, map_texts, whole_text, written

#: Labelled rows used to fit, at most: those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 8_000
BUCKETS, DIM, HIDDEN, NEIGHBOURS = 1 << 14, 64, 32, 2
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
EMPTY, SAME, UPPER = "\x00empty", "\x00same", "\x00upper"


def index_vectors() -> np.ndarray:
    """Four +1 and four -1 in each row, the same in every process."""
    g = np.random.Generator(np.random.PCG64(7))
    at = np.argsort(g.random((BUCKETS, DIM)), axis=1)[:, :8]
    out = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(out, at, np.where(np.arange(8) < 4, 1.0, -1.0).astype(np.float32)[None, :], axis=1)
    return out


class Buckets(dict):
    """Bucket of each word in lower case; words in capitals also count as ``UPPER``."""

    def __init__(self):
        super().__init__()
        self.hash = WordHashes(1)

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        b = self[word] = self.hash[word.lower()] % BUCKETS * 2 + (len(word) > 1 and word.isupper())
        return b

    def tokens(self, text: str) -> tuple[np.ndarray, int, int]:
        """Buckets of the words in order, how many are in capitals, how many repeat the one before."""
        words = TOKEN.findall(text)
        if not words:
            return np.array([self[EMPTY] >> 1]), 0, 0
        b = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        upper = int((b & 1).sum())
        b >>= 1
        return b, upper, int((b[1:] == b[:-1]).sum())


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, sums, buckets = index_vectors(), np.zeros((BUCKETS, DIM), np.float32), Buckets()
    for _, texts in arrow_texts(batches):
        for text in texts:
            b = buckets.tokens(text)[0]
            for k in range(1, NEIGHBOURS + 1):
                if len(b) > k:
                    np.add.at(sums, b[k:], index[b[:-k]])
                    np.add.at(sums, b[:-k], index[b[k:]])
    at = np.flatnonzero(np.abs(sums).sum(axis=1))
    vectors = pa.array(sums[at].astype(np.float64).tolist(), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), vectors], ["bucket", "v"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """All that scoring needs; its size is fixed by BUCKETS, DIM and HIDDEN."""

    words: np.ndarray
    layers: list[np.ndarray] | None
    temperature: float
    prior: float

    def pooled(self, buckets: Buckets, text: str) -> np.ndarray:
        b, upper, same = buckets.tokens(text)
        n = len(b)
        counts = np.bincount(b, minlength=0)
        at = np.flatnonzero(counts)
        x = counts[at].astype(np.float32) @ self.words[at]
        x += upper * self.words[buckets[UPPER] >> 1] + same * self.words[buckets[SAME] >> 1]
        return x / n

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(forward(self.layers, x)[1] / self.temperature, -30, 30)))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale, w1, b1, w2, b2 = layers
    h = np.maximum((x - mean) / scale @ w1 + b1, 0)
    return h, h @ w2 + b2


def train_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> list[np.ndarray]:
    """Adam on the log loss; both classes weigh the same, but for a floor that keeps small ones from ruling."""
    g = np.random.Generator(np.random.PCG64(11))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    params = [g.normal(0, (2 / DIM) ** 0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), g.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(())]
    z = (x - mean) / scale
    rare = max(min(y.mean(), 1 - y.mean()), 0.05)
    weight = np.where(y == (y.mean() < 0.5), 0.5 / rare, 0.5 / (1 - rare))
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    batch = min(128, len(z))
    for _ in range(epochs):
        order = g.permutation(len(z))
        for s in range(0, len(z) - batch + 1, batch):
            k = order[s : s + batch]
            w1, b1, w2, b2 = params
            h = np.maximum(z[k] @ w1 + b1, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[k]) * weight[k] / batch
            dh = np.outer(d, w2) * (h > 0)
            t += 1
            for i, grad in enumerate((z[k].T @ dh + decay * w1, dh.sum(axis=0), h.T @ d + decay * w2, d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return [mean, scale, *params]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a grid that is fine around 1."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: str):
    """Rows that no model may learn from: crc32 of the id as text divides by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS
) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    Ids or labels that are null are ignored; if an id is labelled twice, the larger label
    holds; rows that share an id are all learned from. Other columns are ignored, whatever their names. With labels of one class only (or none) every score is that class's smoothed share.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    usable = usable.filter(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = written(texts.join(F.broadcast(sample), "_id"), "quality-sample")

    index = index_vectors()
    few = rows.select("_text").repartition(8)
    sums = map_texts(few, context_sums, "bucket int, v array<double>").groupBy("bucket").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)))
    words = index.copy()
    for r in sums.collect():
        words[r[0]] += np.array(r[1:], np.float32)
    model = Model(unit(words), None, 1.0, 0.5)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch, got in arrow_texts(batches):
            x = [shared.value.pooled(buckets, t).astype(np.float64).tolist() for t in got]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(x, pa.list_(pa.float64()))], ["_id", "_y", "x"])

    id_type = rows.schema["_id"].dataType.simpleString()
    got = map_texts(rows, pool, f"_id {id_type}, _y int, x array<double>").toPandas().sort_values("_id")
    shared.unpersist()
    if got.empty:
        return model
    x, y = np.array(got["x"].tolist()), got["_y"].to_numpy(np.float64)
    model.prior = float((y.sum() + 1) / (len(y) + 2))
    back = np.arange(len(y)) % 5 == 0
    if min(y.sum(), len(y) - y.sum()) < 2:
        return model
    layers = train_network(x[~back], y[~back]) if 0 < y[~back].mean() < 1 else train_network(x, y)
    logits = forward(layers, x[back])[1]
    model.layers, model.temperature = layers, calibrate(logits, y[back])
    return model


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1, row by row: nothing is shuffled.

    Null and empty texts are scored as a text of no words; very long ones are scored whole. A column of ``docs`` that is
    called like ``score_col`` comes back with ``_in`` after its name. An empty table gives an empty result.
    """
    taken = score_col
    while taken in docs.columns:
        taken += "_in"
    docs = docs.withColumnRenamed(score_col, taken)
    text_col = taken if text_col == score_col else text_col
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            x = np.array([shared.value.pooled(buckets, t or "") for t in texts], np.float64).reshape(len(texts), DIM)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x), pa.float64())], [*batch.schema.names, score_col])

    return map_texts(docs, score, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))

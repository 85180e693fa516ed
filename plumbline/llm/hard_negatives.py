"""Hard negatives by angular triangle filtering.

Each vector keeps its angles to ``REFERENCES`` directions. By the triangle inequality the angle of two vectors is at least
the greatest difference and at most the least sum of their angles to any of these; the cosines of both ends, multiplied by the norms and
widened against rounding, bound the score, the integer inner product. Only vectors whose bounds
overlap a window that is searched are scored.

A window of scores is searched twice. First each anchor's positives: all scores of its label, where what is already found raises
the lower end. Then, for each positive of score p, what other labels have from ``least`` percent of p to p.

Rows lie in cells and anchors in blocks, both by their nearest references and of bounded size; the least and the greatest of their angles and
norms bound the scores of a block with a whole cell, so cells that cannot overlap never meet the block. A
block and a run of its cells are a task's unit of work: it holds the block, lets the rows stream by, and gives for each window its best rows only.
Anchors are a query set against all rows, in blocks: work is at most their product, and what is shuffled is a row for each
block that its cell can matter to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, map_texts, split_join, written

REFERENCES = 16
#: Rows of smallest hash that directions are chosen from. They decide how tight bounds are, never what is found.
SAMPLE = 1024
#: Rows of a cell, anchors of a block, cells of a run.
CELL, BLOCK, RUN = 1024, 512, 16
#: Radians by which angles are widened.
SLACK = 1e-6
LARGEST = (1 << 63) - 1
VECTOR = "_row bigint, _id bigint, _label string, _anchor boolean, _v binary, _norm double"


def quantised(scale: float):
    """Rows that take part, each component x as floor(scale x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vectors, norms = [], [], []
            for k, x in enumerate(batch.column("_x")):
                if x.is_valid and not x.values.null_count:
                    with np.errstate(over="ignore"):
                        v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(v).all():
                        most = np.abs(v).max(initial=0)
                        kept.append(k)
                        vectors.append(v.tobytes())
                        norms.append(float(most) and float(most) * float(np.linalg.norm(v / most)))
            at = pa.array(kept, pa.int64())
            columns = [batch.column(c).take(at) for c in ("_id", "_label", "_anchor")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], ["_id", "_label", "_anchor", "_v", "_norm"])

    return run


def padded(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of different lengths as a matrix; what one lacks is 0."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def chosen(vectors: list[np.ndarray], n: int) -> np.ndarray:
    """Up to ``n`` directions, each the farthest from those before it."""
    x = unit(padded(vectors))
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((1, 1))
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(n, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def angles_to(references: np.ndarray):
    """Adds the angles to ``references``; a vector of zeros has angles of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(padded([np.frombuffer(v, np.float64) for v in batch.column("_v").to_pylist()]))
            d = min(x.shape[1], references.shape[1])
            angles = np.arccos(np.clip(x[:, :d] @ references[:, :d].T, -1, 1))
            angles[batch.column("_norm").to_numpy() == 0] = 0
            lists = pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), len(references)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "_angles"])

    return run


def bounds(angles_a: np.ndarray, norms_a: np.ndarray, angles_b: np.ndarray, norms_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each of a can have with each of b."""
    low = np.zeros((len(norms_a), len(norms_b)))
    high = np.full(low.shape, np.pi)
    for r in range(angles_a.shape[1]):
        np.maximum(low, np.abs(angles_a[:, r, None] - angles_b[None, :, r]), out=low)
        total = angles_a[:, r, None] + angles_b[None, :, r]
        np.minimum(high, np.minimum(total, 2 * np.pi - total), out=high)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = norms_a[:, None] * norms_b[None, :]
        slack = 1 + 1e-9 * norms
        least, most = norms * np.cos(np.minimum(high + SLACK, np.pi)) - slack, norms * np.cos(np.maximum(low - SLACK, 0)) + slack
    least, most = np.where(np.isfinite(norms), least, -np.inf), np.where(np.isfinite(norms), most, np.inf)
    return np.minimum(least, float(LARGEST)), np.maximum(most, -float(LARGEST))  # scores end there


def exact_scores(q: np.ndarray, rows: np.ndarray, largest: float) -> list[int]:
    """Integer inner products; ``largest`` bounds the product of norms. Sums of doubles are exact below 2^53."""
    if largest < 2**53:
        return (rows @ q).astype(np.int64).tolist()
    left = [int(x) for x in q]
    return [max(-LARGEST - 1, min(LARGEST, sum(x * int(y) for x, y in zip(left, row, strict=True)))) for row in rows]


class Search:
    """A block of anchors, and the best rows so far of each of their windows."""

    def __init__(self, heads: pa.Table, same_label: bool, best: int, least: int):
        self.same, self.best = same_label, best
        self.vectors = padded([np.frombuffer(v, np.float64) for v in heads.column("_v").to_pylist()])
        self.norms, self.labels = heads.column("_norm").to_numpy(), heads.column("_label").to_pylist()
        self.angles = np.array(heads.column("_angles").to_pylist(), np.float64)
        self.rows = heads.column("_row").to_pylist()
        ends = [[None] if scores is None else scores for scores in heads.column("_scores").to_pylist()]
        places = max(map(len, ends))
        # bounds are doubles: a window's ends are widened to the doubles beside them
        self.window = [[None if p is None else (-(-least * p // 100), p) for p in scores] for scores in ends]
        self.low, self.high = np.full((len(ends), places), np.inf), np.full((len(ends), places), -np.inf)
        for k, windows in enumerate(self.window):
            for p, w in enumerate(windows):
                self.low[k, p], self.high[k, p] = (-np.inf, np.inf) if w is None else (np.nextafter(float(w[0]), -np.inf), np.nextafter(float(w[1]), np.inf))
        self.found: list[list[list[tuple]]] = [[[] for _ in w] for w in self.window]

    def look(self, tails: pa.Table) -> None:
        norms, ids, rows = tails.column("_norm").to_numpy(), tails.column("_id").to_pylist(), tails.column("_row").to_pylist()
        least, most = bounds(self.angles, self.norms, np.array(tails.column("_angles").to_pylist(), np.float64), norms)
        codes: dict = {}
        code = lambda labels: np.array([codes.setdefault(x, len(codes)) for x in labels])
        allowed = (code(self.labels)[:, None] == code(tails.column("_label").to_pylist())[None, :]) == self.same
        overlap = np.zeros(allowed.shape, bool)
        for p in range(self.low.shape[1]):
            overlap |= (most >= self.low[:, p, None]) & (least <= self.high[:, p, None])
        overlap &= allowed
        if not overlap.any():
            return
        vectors = padded([np.frombuffer(v, np.float64) for v in tails.column("_v").to_pylist()])
        d = min(vectors.shape[1], self.vectors.shape[1])
        for k in np.flatnonzero(overlap.any(axis=1)).tolist():
            at = np.flatnonzero(overlap[k])
            scores = exact_scores(self.vectors[k, :d], vectors[at, :d], float(self.norms[k]) * float(norms[at].max()))
            for p, w in enumerate(self.window[k]):
                low, high = (-LARGEST - 1, LARGEST) if w is None else w
                best = self.found[k][p]
                worst = -best[-1][0] if len(best) == self.best else low
                new = [(-s, ids[j], rows[j]) for s, j in zip(scores, at.tolist(), strict=True) if worst <= s <= high and rows[j] != self.rows[k]]
                if new:
                    best = self.found[k][p] = sorted(best + new)[: self.best]
                    if len(best) == self.best:
                        self.low[k, p] = max(self.low[k, p], np.nextafter(float(-best[-1][0]), -np.inf))

    def results(self) -> pa.RecordBatch:
        rows = [(self.rows[k], p, row, i, -s) for k, windows in enumerate(self.found) for p, best in enumerate(windows) for s, i, row in best]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["_a", "_p", "_row", "_id", "_score"])


def searched(same_label: bool, best: int, least: int):
    """Rows come sorted by (_block, _run), a block's anchors before the rows of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, search = None, [], None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            marks = list(zip(*(part.column(c).to_pylist() for c in ("_block", "_run", "_tail")), strict=True))
            cut = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]
            for a, z in zip(cut, cut[1:]) if marks else ():
                if marks[a][:2] != key:
                    if search:
                        yield search.results()
                    key, heads, search = marks[a][:2], [], None
                if not marks[a][2]:
                    heads.append(part.slice(a, z - a))
                    continue
                if search is None:
                    search, heads = Search(pa.concat_tables(heads), same_label, best, least), []
                search.look(part.slice(a, z - a))
        if search:
            yield search.results()

    return run


def grouped(steps: Steps, rows: DataFrame, by: list[str], n: int, most: int, name: str) -> DataFrame:
    """``rows``, ``n`` of them, with a group's hash in ``name``: rows of the same ``by`` and nearest reference, ``most`` of them at the average."""
    near = F.slice("_angles", 1, max(1, min(REFERENCES, -(-n // most))))
    rows = rows.withColumn("_near", F.array_position(near, F.array_min(near)))
    keys = [*by, "_near"]
    sizes = steps.written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")), f"{name}-sizes")
    dealt = split_join(rows, sizes, keys, "_k")
    part = F.pmod(F.xxhash64("_row"), F.ceil(F.col("_k") / most))
    return dealt.withColumn(name, F.xxhash64(*keys, part)).drop("_near", "_k")


def summary(rows: DataFrame, key: str, by: list[str], references: int, more: tuple[Column, ...] = ()) -> DataFrame:
    every = range(references)
    low, high = F.array(*[F.min(F.col("_angles")[r]) for r in every]), F.array(*[F.max(F.col("_angles")[r]) for r in every])
    return rows.groupBy(key, *by).agg(low.alias("low"), high.alias("high"), F.min("_norm").alias("n0"), F.max("_norm").alias("n1"), F.count(F.lit(1)).alias("n"), *more)


def met(blocks: DataFrame, cells: DataFrame, by: list[str], references: int, parts: int) -> DataFrame:
    """Blocks and cells with the least and the greatest score (_least, _most) of any anchor of one with any row of the other."""
    a = blocks.select(*[F.col(c).alias(f"a_{c}" if c in ("low", "high", "n0", "n1", "n") else c) for c in blocks.columns])
    if not by:  # each block with all cells, in parts
        by = ["_part"]
        a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cells = cells.withColumn("_part", F.pmod(F.xxhash64("_cell"), F.lit(parts)).cast("int"))
    both = a.join(cells, by)
    each = F.sequence(F.lit(0), F.lit(references - 1))
    at = lambda c, r: F.col(c)[r]
    nearest = F.array_max(F.transform(each, lambda r: F.greatest(at("a_low", r) - at("high", r), at("low", r) - at("a_high", r))))
    farthest = F.array_min(F.transform(each, lambda r: F.least(at("a_high", r) + at("high", r), F.lit(2 * math.pi) - at("a_low", r) - at("low", r))))
    best, worst = F.cos(F.greatest(nearest - SLACK, F.lit(0.0))), F.cos(F.least(farthest + SLACK, F.lit(math.pi)))
    large, small = F.col("a_n1") * F.col("n1"), F.col("a_n0") * F.col("n0")
    slack = 1 + 1e-9 * large
    most = best * F.when(best >= 0, large).otherwise(small) + slack
    least = worst * F.when(worst >= 0, small).otherwise(large) - slack
    finite = large < float("inf")
    least, most = F.when(finite, least).otherwise(float("-inf")), F.when(finite, most).otherwise(float("inf"))
    return both.withColumns({"_least": F.least(least, F.lit(float(LARGEST))), "_most": F.greatest(most, F.lit(-float(LARGEST)))})


def search(steps: Steps, anchors: DataFrame, rows: DataFrame, pairs: DataFrame, runs: int, same_label: bool, best: int, least: int) -> DataFrame:
    """(_a, _p, _row, _id, _score): for each anchor and window its ``best`` rows in the cells that its block meets."""
    pairs = steps.written(pairs.select("_block", "_cell", F.pmod(F.xxhash64("_cell"), F.lit(runs)).alias("_run")), "pairs")
    shown = ["_block", "_run", "_tail", "_row", "_id", "_label", "_v", "_norm", "_angles", "_scores"]
    heads = anchors.join(pairs.select("_block", "_run").distinct(), "_block").withColumn("_tail", F.lit(False))
    tails = rows.join(pairs, "_cell").withColumns({"_tail": F.lit(True), "_scores": F.lit(None).cast("array<bigint>")})
    both = heads.select(shown).unionByName(tails.select(shown)).repartition("_block", "_run").sortWithinPartitions("_block", "_run", "_tail", "_row")
    found = map_texts(both, searched(same_label, best, least), "_a bigint, _p bigint, _row bigint, _id bigint, _score bigint")
    rank = F.row_number().over(Window.partitionBy("_a", "_p").orderBy(F.desc("_score"), "_id", "_row"))
    return steps.written(found.withColumn("_rank", rank).filter(F.col("_rank") <= best), "found")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, least: int = 80, scale: int = 256) -> DataFrame:
    """Rows of other labels that score nearly as an anchor's positives: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Each component x is floor(scale x); a score is the integer inner product with the anchor; higher scores come first, ties by smaller
    id. An anchor's positives are the first ``positives`` other rows of its label, or all if they are fewer. For each, the result has
    the first ``negatives`` rows of other labels with ``least`` positive_score <= 100 negative_score <= 100 positive_score, or all;
    none if the positive's score is negative. ``rank`` counts from 1.

    Rows with a null id, label or vector, or with a component that is null or not finite (once scaled too), take no part; ``is_anchor`` is
    false where it is null. Of vectors of different lengths the shorter one counts as if it had zeros; empty ones and
    those of zeros score 0. Repeated rows are rows of their own: each is mined for, and each is another row to its copies.
    A score beyond 64 bits is the largest of them. Very long vectors are read whole. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    taken = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("string").alias("_label"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"), F.col(vec_col).cast("array<double>").alias("_x"))
    taken = taken.filter("_id is not null and _label is not null and _x is not null")
    with Steps(vectors.sparkSession) as steps:
        plain = map_texts(taken, quantised(float(scale)), "_id bigint, _label string, _anchor boolean, _v binary, _norm double")
        plain = steps.written(plain.select(F.monotonically_increasing_id().alias("_row"), "*"), "plain")
        sample = plain.orderBy(F.xxhash64("_id"), "_row").limit(SAMPLE).select("_v").collect()
        references = chosen([np.frombuffer(bytes(r[0]), np.float64) for r in sample], REFERENCES)
        r = len(references)
        rows = steps.written(map_texts(plain, angles_to(references), f"{VECTOR}, _angles array<double>"), "rows")
        anchors = rows.filter("_anchor").withColumn("_scores", F.lit(None).cast("array<bigint>"))
        n, m = rows.count(), anchors.count()
        runs = max(1, -(-n // (CELL * RUN)))

        blocks = steps.written(grouped(steps, anchors, ["_label"], m, BLOCK, "_block"), "blocks")
        cells = steps.written(grouped(steps, rows, ["_label"], n, CELL, "_cell"), "cells")
        pairs = met(summary(blocks, "_block", ["_label"], r), summary(cells, "_cell", ["_label"], r), ["_label"], r, 1)
        # a cell of more rows than are wanted, of which one may be the anchor itself, sets the least that others must be able to reach
        floor = F.max(F.when(F.col("n") > positives, F.col("_least"))).over(Window.partitionBy("_block"))
        pairs = pairs.withColumn("_floor", floor).filter(F.col("_floor").isNull() | (F.col("_most") >= F.col("_floor")))
        own = search(steps, blocks, cells, pairs, runs, True, positives, least)
        own = own.select("_a", (F.col("_rank") - 1).alias("_p"), F.col("_id").alias("positive_id"), F.col("_score").alias("positive_score"))

        scores = F.transform(F.array_sort(F.collect_list(F.struct("_p", "positive_score"))), lambda x: x["positive_score"])
        windows = own.groupBy(F.col("_a").alias("_row")).agg(scores.alias("_scores"))
        asking = anchors.drop("_scores").join(windows, "_row").filter(F.array_max("_scores") >= 0)
        blocks = steps.written(grouped(steps, asking, [], m, BLOCK, "_block"), "asking")
        cells = steps.written(grouped(steps, rows, [], n, CELL, "_cell"), "all-cells")
        top, low = F.max(F.array_max("_scores")).alias("top"), F.min(F.array_min(F.filter("_scores", lambda s: s >= 0))).alias("bottom")
        pairs = met(summary(blocks, "_block", [], r, (top, low)), summary(cells, "_cell", [], r), [], r, max(1, n // (CELL * 64)))
        pairs = pairs.filter((F.col("_most") >= F.col("bottom") * (least / 100.0) - 1) & (F.col("_least") <= F.col("top") + 1.0))
        others = search(steps, blocks, cells, pairs, runs, False, negatives, least)

        ids = anchors.select(F.col("_row").alias("_a"), F.col("_id").alias("anchor_id"))
        out = others.select("_a", "_p", F.col("_rank").alias("rank"), F.col("_id").alias("negative_id"), F.col("_score").alias("negative_score")).join(own, ["_a", "_p"]).join(ids, "_a")
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")

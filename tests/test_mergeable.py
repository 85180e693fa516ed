"""Samples, quantile sketches and growing histograms: parts merge to the whole."""

import math
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import columns as C
from plumbline.operators import mergeable as M
from plumbline.streaming import profile as P


def brute_bins(values):
    x = [v for v in values if v is not None and math.isfinite(v)]
    if not x:
        return None
    most = max(map(abs, x))
    e = max(M.LOWEST, math.frexp(most)[1] - M.BITS) if most else M.LOWEST
    at = lambda v: math.floor(Fraction(v) / Fraction(2) ** e)
    while at(max(x)) - at(min(x)) >= M.MOST_BINS:
        e += 1
    counts = {}
    for v in x:
        i = at(v)
        counts[i] = counts.get(i, 0) + 1
    return e, sorted(counts.items())


def grown(parts):
    b = M.Bins()
    for p in parts:
        b.add(np.array(p, np.float64))
    return (b.e, sorted(b.counts.items())) if b.counts else None


numbers = st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1e-300, -1e300, 5e-324, 1e17, math.inf, math.nan, 3.0, 2.0**40]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(numbers, max_size=12), min_size=1, max_size=5))
def test_bins_that_grow_equal_a_plain_recount(parts):
    assert grown(parts) == brute_bins([v for p in parts for v in p])


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.Generator(np.random.PCG64(5))
    out = []
    for i in range(3000):
        spread = float(g.normal() * 10 ** (i % 9))
        out.append((i, None if i % 11 == 0 else spread, float("nan") if i % 13 == 0 else float(i % 40), i % 7, f"t{i % 23}", None))
    return spark.createDataFrame(out, "id bigint, spread double, steps double, part int, word string, nothing double").repartition(4).cache()


def bins(df):
    return {r["column_name"]: (r["histogram"]["e"], [(b["i"], b["n"]) for b in r["histogram"]["bins"]]) for r in df.collect()}


def test_histograms_of_parts_merge_to_that_of_the_whole(rows):
    names = ["spread", "steps", "nothing", "part"]
    whole = bins(M.histogram_states(rows, names))
    data = rows.collect()
    assert whole == {c: brute_bins([r[c] for r in data]) for c in ("spread", "steps", "part")}
    parts = M.histogram_states(rows, names, "part")
    assert bins(M.merged_histograms(parts, ["column_name"])) == whole
    coarse = M.merged_histograms(parts.withColumn("g", F.col("batch_id") > "3"), ["g", "column_name"])  # in two steps, in another grouping
    assert bins(M.merged_histograms(coarse, ["column_name"])) == whole


def batch_of(groups, values):
    return pa.record_batch([pa.array(groups, pa.string()), pa.array(values, pa.float64())], ["batch_id", "x0"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), numbers)), max_size=12), min_size=1, max_size=5))
def test_bins_of_many_groups_at_once_equal_a_plain_recount(parts):
    out = list(M.binned(["x"], ["batch_id"])(batch_of(*zip(*p)) if p else batch_of([], []) for p in parts))
    got = {}
    for r in pa.Table.from_batches(out).to_pylist() if out else []:
        got.setdefault(r["batch_id"], {})[r["i"]] = r["n"]
        assert r["column_name"] == "x"
    want = {g: brute_bins([v for p in parts for k, v in p if k == g]) for g in {k for p in parts for k, _ in p}}
    assert got == {g: dict(w[1]) for g, w in want.items() if w}


def test_time_does_not_grow_with_groups():
    g = np.random.Generator(np.random.PCG64(3))
    parts = [batch_of([str(k) for k in range(10_000)], g.random(10_000)) for _ in range(5)]
    began = time.process_time()
    out = list(M.binned(["x"], ["batch_id"])(iter(parts)))
    assert time.process_time() - began < 3 and sum(pa.compute.sum(b["n"]).as_py() for b in out) == 50_000


def test_bins_are_shuffled_once(rows):
    plan = M.histogram_states(rows, ["spread", "part"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def test_one_scan_for_a_histogram(rows):
    plan = M.histogram_states(rows.select("spread"), ["spread"])._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Join Cross" not in plan


def samples(df):
    return {r["column_name"]: [s["v"] for s in r["sample"]] for r in df.collect()}


def test_samples_of_parts_merge_to_that_of_the_whole(rows):
    key, names = F.md5(F.col("id").cast("string")), ["id", "spread", "word", "nothing"]
    whole = samples(M.column_samples(rows, key, names))
    want = C.value_sample(rows, key, names).orderBy("column_name", "rank").collect()
    assert whole == {c: [r["value"] for r in want if r["column_name"] == c] for c in names}
    parts = M.column_samples(rows, key, names, "part")
    assert samples(M.merged_samples(parts, ["column_name"])) == whole
    assert whole["nothing"] == [None] * 10


def test_a_sample_is_fair(spark):
    df = spark.range(4000)
    keys = [F.md5(F.concat(F.lit(f"{s}:"), F.col("id").cast("string"))) for s in range(40)]
    picked = [int(v) for k in keys for v in samples(M.column_samples(df, k, ["id"]))["id"]]
    assert abs(np.mean(picked) - 2000) < 200 and len(set(picked)) > 350


def test_quantiles_of_merged_sketches_hold_their_bound(spark, tmp_path):
    df = spark.range(200_000).select(F.expr("pow(cast(id * 7919 % 200003 as double), 1.5)").alias("x"), (F.col("id") % 40).alias("part"))
    P.grouped_partial_state(df, "part", ["x"]).write.parquet(str(tmp_path / "s"))
    got = P.profile_of_state(P.merge_states(spark.read.parquet(str(tmp_path / "s")))).collect()[0]
    assert got["row_count"] == 200_000
    for k, q in C.QUANTILES.items():
        rank = df.filter(F.col("x") <= got[k]).count() / 200_000
        assert abs(rank - q) <= 2.3 / M.KLL_K**0.9


def test_a_state_has_all_measures_of_odd_columns(rows, spark, tmp_path):
    at = str(tmp_path / "s")
    for k in range(7):
        P.put_batch(rows.filter(F.col("part") == k), k, "t", at, key=F.md5(F.col("id").cast("string")))
    P.put_batch(rows.limit(0), 7, "t", at)
    before = {r["column_name"]: r for r in P.current_profile(spark, at, "t").collect()}
    P.put_batch(rows.filter("part = 2"), 2, "t", at, key=F.md5(F.col("id").cast("string")))  # delivered again
    P.compact_state(spark, at, str(tmp_path / "c"))
    for path in (at, str(tmp_path / "c")):
        after = {r["column_name"]: r for r in P.current_profile(spark, path, "t").collect()}
        for c in rows.columns:
            assert (after[c]["row_count"], after[c]["histogram"], after[c]["sample"]) == (before[c]["row_count"], before[c]["histogram"], before[c]["sample"])
    assert before["word"]["histogram"] is None and before["word"]["median"] is None and before["word"]["row_count"] == 3000
    assert before["nothing"]["histogram"] is None and before["nothing"]["missing_count"] == 3000
    want = C.value_sample(rows, F.md5(F.col("id").cast("string")), ["spread"]).orderBy("rank").collect()
    assert before["spread"]["sample"] == [r["value"] for r in want]
    assert sum(b["count"] for b in before["steps"]["histogram"]) == before["steps"]["row_count"]
    assert all(b["lo"] <= 39 and b["hi"] > 0 for b in before["steps"]["histogram"])

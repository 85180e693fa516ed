import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import types as K
from plumbline.operators import columns as C


def rows(df, key="column_name"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    data = [(None, 7, 0.0, None if i else 5.0, i % 2 == 0, -float(i), 1e9 if i == 0 else float(i % 10), f"t{i % 3}" if i else None) for i in range(100)]
    return spark.createDataFrame(data, "all_null double, seven int, zero double, one double, flag boolean, negative double, skewed double, text string").cache()


def test_counts_and_moments(edge):
    got = rows(C.profile_columns(edge))
    pdf = edge.toPandas()
    for c in ("negative", "skewed"):
        x = pdf[c].astype(float)
        assert got[c]["row_count"] == 100 and got[c]["missing_count"] == 0
        assert got[c]["mean"] == pytest.approx(x.mean()) and got[c]["variance"] == pytest.approx(x.var())
        assert got[c]["standard_deviation"] == pytest.approx(x.std()) and got[c]["range_value"] == x.max() - x.min()
        assert got[c]["unique_count"] == x.nunique()
    assert list(C.profile_columns(edge).orderBy("position").toPandas().column_name) == edge.columns


def test_all_null_single_and_boolean(edge):
    got = rows(C.profile_columns(edge))
    assert (got["all_null"]["row_count"], got["all_null"]["unique_count"], got["all_null"]["histogram"], got["all_null"]["mean"]) == (0, 0, [], None)
    assert got["all_null"]["missing_percentage"] == 100
    assert got["one"]["variance"] is None and got["one"]["mean"] == 5.0 and got["one"]["median"] == 5.0
    flag = got["flag"]
    assert flag["data_type"] == "sc:Float" and flag["mean"] == 0.5 and flag["percentile05"] is None and flag["median"] is not None
    text = got["text"]
    assert text["data_type"] == "sc:Text" and text["row_count"] == 99 and text["missing_count"] == 1 and text["histogram"] is None and text["mean"] is None


def test_empty_table_has_no_measures(spark):
    got = rows(C.profile_columns(spark.createDataFrame([], "a int, b string")))
    assert got["a"]["row_count"] is None and got["a"]["missing_percentage"] is None and got["b"]["unique_count"] is None and got["a"]["histogram"] is None


def test_degenerate_histograms(edge):
    got = rows(C.profile_columns(edge))
    h = got["seven"]["histogram"]
    assert len(h) == 10 and h[0]["lo"] == pytest.approx(6.993) and h[-1]["hi"] == pytest.approx(7.007) and sum(b["count"] for b in h) == 100
    assert got["zero"]["histogram"][0]["lo"] == pytest.approx(-0.001)


@pytest.mark.parametrize("seed", range(4))
def test_histogram_like_pandas_cut(spark, seed):
    g = random.Random(seed)
    x = [g.choice([g.gauss(0, 3), float(g.randint(0, 20)), g.expovariate(0.1)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    h = rows(C.profile_columns(df))["x"]["histogram"]
    cut = pd.cut(pd.Series(x), bins=np.concatenate([[min(x) - (max(x) - min(x)) * 0.001], np.linspace(min(x), max(x), 11)[1:]])).value_counts(sort=False)
    assert [b["count"] for b in h] == cut.tolist() and sum(b["count"] for b in h) == len(x)


def test_known_histogram_quantiles(spark):
    """A column of four values whose 5th and 95th percentile by histogram are known."""
    counts = {1: 193, 2: 16601, 3: 3422, 4: 141}
    df = spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "x int")
    p = rows(C.profile_columns(df))["x"]
    assert [b["count"] for b in p["histogram"]] == [193, 0, 0, 16601, 0, 0, 3422, 0, 0, 141]
    assert p["percentile05"] == pytest.approx(1.9149060297572436, abs=1e-12) and p["percentile95"] == pytest.approx(3.0231282875511396, abs=1e-12)
    assert p["mean"] == pytest.approx(2.1724713857641107) and p["variance"] == pytest.approx(0.1755478956859014) and p["unique_count"] == 4


def test_quantiles_are_ordered_and_exact(spark):
    g = random.Random(3)
    x = [g.lognormvariate(0, 2) for _ in range(2000)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for p in (rows(C.profile_columns(df))["x"], rows(C.profile_columns(df, quantiles="exact"))["x"]):
        assert p["min_value"] <= p["percentile05"] <= p["median"] <= p["percentile95"] <= p["max_value"]
    assert p["median"] == pytest.approx(np.percentile(x, 50)) and p["percentile95"] == pytest.approx(np.percentile(x, 95))
    for few, accuracy in ((1000, 10_000), (10, 20), (1, 10_000)):
        got = {float(r["q"]): r["value"] for r in C.refined_quantiles(df, ["x"], (0.0, 0.05, 0.5, 0.95, 1.0), few, accuracy).collect()}
        for q, v in got.items():
            assert v == pytest.approx(np.percentile(x, 100 * q)), (q, few)
        assert len(got) == 5


@pytest.mark.parametrize("values", [[7.0] * 500, [1.0] * 300 + [2.0] * 300, [float(i % 3) for i in range(700)], [float(i * i) for i in range(900)], [1.0] * 400 + [float(i) for i in range(9)], []])
def test_refined_quantiles_with_ties(spark, values):
    df = spark.createDataFrame([(v, None if i % 2 else v) for i, v in enumerate(values)], "x double, y double")
    for few, accuracy in ((5, 10_000), (5, 16), (10**6, 100)):
        got = {(r["column_name"], float(r["q"])): r["value"] for r in C.refined_quantiles(df, ["x", "y"], (0.05, 0.5, 0.95), few, accuracy).collect()}
        for c, kept in (("x", values), ("y", values[::2])):
            for q in (0.05, 0.5, 0.95):
                assert got[c, q] == (pytest.approx(np.percentile(kept, 100 * q)) if kept else None)


def test_distinct_values_within_a_budget(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("few"))
    got = {r["column_name"]: r for r in C.budgeted_counts(df, budget=100).collect()}
    assert got["few"]["unique_count"] == 7 and not got["few"]["unique_is_estimate"]
    assert got["id"]["unique_is_estimate"] and abs(got["id"]["unique_count"] - 3000) < 450
    p = {r["column_name"]: r for r in C.profile_columns(df, distinct="budget").collect()}
    assert p["id"]["unique_count"] == 3000 and not p["id"]["unique_is_estimate"]


def test_nan_is_missing(spark):
    p = rows(C.profile_columns(spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double")))["x"]
    assert p["row_count"] == 1 and p["missing_count"] == 2 and p["max_value"] == 1.0


def test_width_bucket_puts_the_maximum_apart(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = {r["bucket"]: r["n"] for r in C.width_bucket_histogram(df, "x").collect()}
    assert got[11] == 1 and sum(got.values()) == 11


def test_samples_are_reproducible_and_keep_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"v{i}") for i in range(50)], "id int, v string")
    one = [tuple(r) for r in C.value_sample(df, F.md5(F.col("id").cast("string")), ["v"]).orderBy("rank").collect()]
    two = [tuple(r) for r in C.value_sample(df.repartition(7), F.md5(F.col("id").cast("string")), ["v"]).orderBy("rank").collect()]
    assert one == two and len(one) == 10 and any(r[2] is None for r in one)
    assert [r["value"] for r in C.distinct_value_sample(df, "v", "id").collect()] == ["v0", "v10", "v12"]


def test_examples_have_nan_as_null(spark):
    df = spark.createDataFrame([(2, math.nan), (1, 1.5)], "id int, x double")
    assert rows(C.table_examples(df, "id"))["x"]["examples"] == "[1.5,null]"


def test_type_votes(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2020-01-01", "-3", "a", "1"), ("2", "2.5", "2020-02-01", "+4", "b", "2.5"), ("x", "3", "n", "5", None, "2020-01-01")],
        "i string, f string, d string, s string, t string, tie string",
    )
    got = {r["column_name"]: r["data_type"] for r in C.infer_types(df).collect()}
    assert got == {"i": K.INTEGER, "f": K.FLOAT, "d": K.DATE, "s": K.INTEGER, "t": K.TEXT, "tie": K.FLOAT}


def test_sql_types_are_total(spark):
    names = ["INTEGER", "bigint", "FLOAT", "DOUBLE PRECISION", "NUMERIC(10,2)", "VARCHAR", "DATE", "TIMESTAMP WITH TIME ZONE", "TEXT", "INTERVAL", "JSONB", "BOOLEAN"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", K.sql_semantic_type(F.col("n")).alias("k"))
    got = dict(tuple(r) for r in df.collect())
    assert got["DOUBLE PRECISION"] == got["NUMERIC(10,2)"] == K.FLOAT and got["bigint"] == K.INTEGER and got["INTERVAL"] == got["VARCHAR"] == K.TEXT and got["TIMESTAMP WITH TIME ZONE"] == K.DATE
    assert None not in got.values()


def test_nested_columns_have_counts_only(spark):
    p = rows(C.profile_columns(spark.createDataFrame([([1], {"a": 1}), (None, None)], "l array<int>, m map<string,int>")))
    assert p["l"]["row_count"] == 1 and p["l"]["missing_count"] == 1 and p["l"]["unique_count"] is None and p["m"]["data_type"] == K.TEXT


def test_odd_names_and_wide_tables(spark):
    wide = spark.range(20).select(*(F.col("id").alias(f"a.b {i}") for i in range(90)))
    got = C.profile_columns(wide, distinct="approx").collect()
    assert len(got) == 90 and all(r["row_count"] == 20 for r in got)
    assert C.profile_columns(wide, ["a.b 1"], scan_limit=5).collect()[0]["row_count"] == 5


def test_several_tables(spark):
    got = C.profile_tables({"a": spark.range(3), "b": spark.range(5), "none": spark.range(1).drop("id")}).collect()
    assert {(r["table_name"], r["row_count"]) for r in got} == {("a", 3), ("b", 5)}

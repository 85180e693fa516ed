"""Profile stores, merged states, running profiles, files written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import columns as C
from plumbline.plans.column_queries import EVENTS, f32
from plumbline.plans.registry import query
from plumbline.session import scratch_dir, table
from plumbline.sources import files, store
from plumbline.streaming import profile as P

_STATE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_MERGED = ("missing_percentage", "mean", "variance", "standard_deviation", "range_value")


@query(
    "latest_profile_per_dataset",
    "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_profile_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of a profile per user: the newest of each is kept."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return store.newest(e.withColumn("_t", F.struct("ts", "event_id")), "user_id", "_t").drop("_t", "ts")


def _compared(p: DataFrame) -> DataFrame:
    return p.select("column_name", "row_count", "missing_count", *map(f32, _MERGED), "min_value", "max_value")


_SQL_MERGED = (
    "SELECT '{1}' AS column_name, count({1}) AS row_count, count(*) - count({1}) AS missing_count, ((count(*) - count({1})) / count(*) * 100)::FLOAT::DOUBLE AS missing_percentage, avg({1}::DOUBLE)::FLOAT::DOUBLE AS mean,"
    " var_samp({1}::DOUBLE)::FLOAT::DOUBLE AS variance, stddev_samp({1}::DOUBLE)::FLOAT::DOUBLE AS standard_deviation, (max({1}) - min({1}))::DOUBLE::FLOAT::DOUBLE AS range_value, min({1})::DOUBLE AS min_value, max({1})::DOUBLE AS max_value FROM {0}"
)


@query("merged_state_profile", " UNION ALL ".join(_SQL_MERGED.replace("{1}", c).replace("{0}", "lineitem") for c in _STATE))
def merged_state_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials by supplier, merged: the same as the profile of all rows."""
    states = P.grouped_partial_state(table(spark, sf_dir, "lineitem"), "l_suppkey", _STATE)
    path = scratch_dir(spark, "states")
    states.write.parquet(path)
    return _compared(P.profile_of_state(P.merge_states(spark.read.parquet(path))))


@query("running_profile", " UNION ALL ".join(_SQL_MERGED.replace("{1}", c).replace("{0}", "events") for c in ("user_id", "value")))
def running_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, profiled batch by batch to a state table."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    state, checkpoint = scratch_dir(spark, "state"), scratch_dir(spark, "stream")
    P.running_profile(stream, "events", state, checkpoint, ["user_id", "value"]).awaitTermination()
    return _compared(P.current_profile(spark, state, "events"))


@query(
    "csv_roundtrip_profile",
    "SELECT 'o_orderkey' AS column_name, 'sc:Integer' AS data_type, count(*) AS row_count, count(DISTINCT o_orderkey) AS unique_count FROM orders"
    " UNION ALL SELECT 'o_totalprice', 'sc:Float', count(*), count(DISTINCT o_totalprice) FROM orders"
    " UNION ALL SELECT 'o_orderpriority', 'sc:Text', count(*) FILTER (o_orderpriority <> '1-URGENT'), count(DISTINCT o_orderpriority) FILTER (o_orderpriority <> '1-URGENT') FROM orders",
)
def csv_roundtrip_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV and read again as text: types by vote, tokens as missing values."""
    path = scratch_dir(spark, "csv")
    kept = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'N/A' ELSE o_orderpriority END AS o_orderpriority")
    kept.write.option("header", True).option("sep", ";").csv(path)
    text = files.read_csv(spark, path, ";", kept.columns, "UTF-8", multi_line=False)
    kinds = {r["column_name"]: r["data_type"] for r in C.infer_types(text).collect()}
    got = C.profile_columns(files.typed(text, kinds))
    return got.select("column_name", "data_type", "row_count", "unique_count")


@query(
    "profile_table_lookup",
    "SELECT 'c' || c_nationkey AS dataset_id, count(*) AS n, max(c_acctbal) AS most FROM customer WHERE c_nationkey = 3 GROUP BY c_nationkey",
)
def profile_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile per nation kept in the partitioned table, and one of them looked up."""
    path = scratch_dir(spark, "profiles")
    by = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("c"), "c_nationkey").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("most"))
    store.put(by, path)
    return store.get(spark, path, "c3").select("dataset_id", "n", "most")


@query(
    "approximate_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS row_count, true AS unique_is_near, {'true' if k in ('sc:Integer', 'sc:Float') else 'NULL::BOOLEAN'} AS quantiles_are_near FROM events" for c, k in EVENTS.items()),
)
def approximate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile in the memory of sketches, whatever the number of distinct values: within the stated errors of the exact one.

    Those are 15 % of the distinct values (three standard errors) and, for quantiles, 0.2 % of the rows.
    """
    df, names = table(spark, sf_dir, "events"), list(EVENTS)
    p = C.profile_columns(df, names, distinct="approx", quantiles="approx")
    exact = C.unique_counts(df, names).withColumnRenamed("unique_count", "exact")
    numbers = [c for c, k in EVENTS.items() if k in ("sc:Integer", "sc:Float")]
    ranks = lambda q: F.array(F.lit(max(0.0, q - 0.002)), F.lit(min(1.0, q + 0.002)))
    wide = df.agg(*(F.percentile(F.col(c).cast("double"), ranks(q)).alias(f"{c}_{k}") for c in numbers for k, q in C.QUANTILES.items()))
    bounds = C.rows_of(wide.withColumns({f"{c}_column_name": F.lit(c) for c in numbers}), [f"{c}_" for c in numbers], {"column_name": "string"} | {k: "array<double>" for k in C.QUANTILES})
    both = p.alias("p").join(F.broadcast(exact), "column_name").join(F.broadcast(bounds.alias("b")), "column_name", "left")
    near = lambda k: (F.col(f"p.{k}") >= F.col(f"b.{k}")[0]) & (F.col(f"p.{k}") <= F.col(f"b.{k}")[1])
    unique = F.abs(F.col("unique_count") - F.col("exact")) <= 0.15 * F.col("exact")
    return both.select("column_name", "row_count", unique.alias("unique_is_near"), (near("percentile05") & near("median") & near("percentile95")).alias("quantiles_are_near"))

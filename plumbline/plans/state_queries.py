"""Samples, quantiles and histograms that come out of merged states, held against the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import columns as C
from plumbline.operators import mergeable as M
from plumbline.plans.registry import query
from plumbline.session import scratch_dir, table, written
from plumbline.streaming import profile as P

_SAMPLED = ("user_id", "event_type", "value", "props")
_BINNED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey")


@query(
    "merged_state_sample",
    "WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(event_id::VARCHAR)) AS rank FROM events)"
    + " UNION ALL ".join(f" SELECT '{c}' AS column_name, rank::INT AS rank, {f'{c}::DECIMAL(18,2)::VARCHAR' if c == 'value' else f'{c}::VARCHAR'} AS value FROM s WHERE rank <= 10" for c in _SAMPLED),
)
def merged_state_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the events of each user, merged: the same values as a sample of all events."""
    e = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    parts = written(M.column_samples(e, F.md5(F.col("event_id").cast("string")), list(_SAMPLED), "user_id"), "samples")
    merged = M.merged_samples(parts, ["column_name"])
    return merged.select("column_name", F.posexplode("sample").alias("rank", "s")).select("column_name", (F.col("rank") + 1).alias("rank"), F.col("s.v").alias("value"))


@query(
    "merged_state_quantiles",
    " UNION ALL ".join(
        f"SELECT l_suppkey AS supplier, '{c}' AS column_name, count(*) AS row_count, " + ", ".join(f"quantile_disc({c}, {q})::DOUBLE AS {k}" for k, q in C.QUANTILES.items()) + " FROM lineitem GROUP BY l_suppkey"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def merged_state_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by supplier and line number, merged by supplier: of up to ``KLL_K`` values the quantiles are exact."""
    lines = table(spark, sf_dir, "lineitem").withColumn("part", F.concat_ws(":", "l_suppkey", "l_linenumber"))
    states = P.grouped_partial_state(lines, "part", ["l_quantity", "l_extendedprice"]).withColumn("supplier", F.split_part("batch_id", F.lit(":"), F.lit(1)).cast("bigint"))
    merged = P.merge_states(written(states, "states"), ("supplier", "column_name"))
    return P.profile_of_state(merged, ("supplier", "column_name")).select("supplier", "column_name", "row_count", *C.QUANTILES)


def sql_growing(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS column_name, i * pow(2.0, e) AS lo, (i + 1) * pow(2.0, e) AS hi, n FROM (
    SELECT e, floor({c} / pow(2.0, e)) AS i, count(*) AS n FROM {source},
      (SELECT min(e) AS e FROM (SELECT unnest(range(-80, 80)) AS e) r, (SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {source}) b
       WHERE floor(mx / pow(2.0, e)) - floor(mn / pow(2.0, e)) < 64 AND e >= floor(log2(greatest(abs(mn), abs(mx)))) + 1 - 40) w
    WHERE {c} IS NOT NULL GROUP BY e, i)"""


def as_bins(states: DataFrame) -> DataFrame:
    return states.select("column_name", F.inline(M.bins_of(F.col("histogram")))).withColumnRenamed("count", "n")


@query("growing_histogram", " UNION ALL ".join(sql_growing("lineitem", c) for c in _BINNED))
def growing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of all columns from one scan that doesn't know their bounds."""
    return as_bins(M.histogram_states(table(spark, sf_dir, "lineitem"), list(_BINNED)))


@query("running_histogram", " UNION ALL ".join(sql_growing(s, c) for s, c in (("events", "value"), ("events", "user_id"), ("(SELECT CASE WHEN event_type = 'click' THEN -value * 1000 END AS spread FROM events)", "spread"))))
def running_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of several batches whose range grows; the state's histograms are those of all events."""
    e = table(spark, sf_dir, "events").select("user_id", "value", F.when(F.col("event_type") == "click", -F.col("value") * 1000).alias("spread"))
    source, state, checkpoint = scratch_dir(spark, "source"), scratch_dir(spark, "state"), scratch_dir(spark, "stream")
    e.repartitionByRange(6, "value").write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source)
    P.running_profile(stream, "events", state, checkpoint).awaitTermination()
    return P.current_profile(spark, state, "events").select("column_name", F.inline("histogram")).withColumnRenamed("count", "n")

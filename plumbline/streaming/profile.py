"""A running column profile: batch partials merged into a state table, once per batch.

The state has a row per table, column and batch: counts, mean and sum of squared deviations
(merged by Chan's formula, which keeps precision for large means), bounds, a sketch of the
distinct values, and what ``operators.mergeable`` has: a sample, a quantile sketch and a histogram that grows. A batch that is
delivered again replaces its own rows, so nothing counts twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.types import is_nested, is_numeric
from plumbline.operators import mergeable as M
from plumbline.operators.columns import QUANTILES, batches, field_types, number, present, rows_of

PARTIAL = {
    "column_name": "string", "total": "bigint", "n": "bigint", "mean": "double", "m2": "double", "min_value": "double", "max_value": "double", "sketch": "binary", "quantiles": "binary"
}


def partial_state(df: DataFrame, columns: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """One row per column that can be merged with others.

    ``key`` orders rows for the sample and should be a hash of the row's own key; it is a hash of all columns if it isn't given.
    """
    kinds = field_types(df, columns)
    out = []
    for batch in batches(list(enumerate(kinds))):
        aggs = [F.count(F.lit(1)).alias("total")]
        for i, (name, kind) in batch:
            aggs.append(F.count(present(name, kind)).alias(f"c{i}_n"))
            if is_numeric(kind):
                x = number(name, kind)
                aggs += [F.avg(x).alias(f"c{i}_mean"), (F.var_pop(x) * F.count(x)).alias(f"c{i}_m2"), F.min(x).alias(f"c{i}_min_value"), F.max(x).alias(f"c{i}_max_value"), F.kll_sketch_agg_double(x, M.KLL_K).alias(f"c{i}_quantiles")]
            if not is_nested(kind):
                aggs.append(F.hll_sketch_agg(present(name, kind).cast("string")).alias(f"c{i}_sketch"))
        wide = df.agg(*aggs).withColumns({f"c{i}_column_name": F.lit(n) for i, (n, _) in batch})
        wide = wide.withColumns({f"c{i}_total": F.col("total") for i, _ in batch})
        out.append(rows_of(wide, [f"c{i}_" for i, _ in batch], PARTIAL))
    names = [n for n, _ in kinds]
    return with_mergeable(reduce(DataFrame.unionByName, out), df, names, key)


def with_mergeable(partials: DataFrame, df: DataFrame, names: list[str], key: Column | None, group: str | None = None) -> DataFrame:
    """``partials`` with the samples and histograms of the same rows."""
    on = ["column_name"] if group is None else ["batch_id", "column_name"]
    samples = M.column_samples(df, M.row_key(df) if key is None else key, names, group)
    bins = M.histogram_states(df, names, group)
    if group is not None:
        bins = bins.withColumn("batch_id", F.col("batch_id").cast(partials.schema["batch_id"].dataType))
    return partials.join(samples, on, "left").join(bins, on, "left")


def grouped_partial_state(df: DataFrame, group: str, columns: list[str], key: Column | None = None) -> DataFrame:
    """The partials of several numeric columns for each value of ``group``, e.g. a day or a shard."""
    kinds = field_types(df, columns)
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (name, kind) in enumerate(kinds):
        x = number(name, kind)
        measures = {"n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "min_value": F.min(x), "max_value": F.max(x), "sketch": F.hll_sketch_agg(present(name, kind).cast("string")), "quantiles": F.kll_sketch_agg_double(x, M.KLL_K)}
        aggs += [m.alias(f"c{i}_{k}") for k, m in measures.items()]
    wide = df.groupBy(F.col(group).alias("batch_id")).agg(*aggs)
    known = {"column_name": lambda i: F.lit(kinds[i][0]), "total": lambda i: F.col("total")}
    part = lambda i: F.struct(*(known.get(k, lambda i, k=k: F.col(f"c{i}_{k}"))(i).cast(t).alias(k) for k, t in PARTIAL.items()))
    return with_mergeable(wide.select("batch_id", F.inline(F.array(*map(part, range(len(kinds)))))), df, columns, key, group)


def merge_states(states: DataFrame, keys: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """One row per column from any number of partials.

    With N = sum n and M = sum n mean / N the merged m2 is sum m2 + sum n (mean - M)^2; the means
    of all partials come first, so nothing large cancels. ``states`` is read several times and should be a written table.
    """
    k = list(keys)
    means = states.groupBy(*k).agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("_all"))
    joined = states.join(means, k)
    merged = joined.groupBy(*k).agg(
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
        F.first("_all").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_all")) * (F.col("mean") - F.col("_all"))).alias("m2"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.hll_union_agg("sketch", F.lit(True)).alias("sketch"),
        F.kll_merge_agg_double("quantiles", M.KLL_K).alias("quantiles"),
    )
    return merged.join(M.merged_samples(states, k), k, "left").join(M.merged_histograms(states, k), k, "left")


def profile_of_state(state: DataFrame, keys: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """The measures of a merged state, as those of a batch profile.

    Percentiles are values of the column, of the least rank that reaches them by the sketch; the histogram has the bins of the state.
    """
    some = F.col("min_value").isNotNull()  # the sketch of a column without numbers is empty
    variance = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1))
    missing = F.col("total") - F.col("n")
    return state.select(
        *keys,
        F.col("n").alias("row_count"),
        missing.alias("missing_count"),
        F.when(F.col("total") > 0, missing / F.col("total") * 100).alias("missing_percentage"),
        "mean",
        variance.alias("variance"),
        F.sqrt(variance).alias("standard_deviation"),
        "min_value",
        "max_value",
        (F.col("max_value") - F.col("min_value")).alias("range_value"),
        F.hll_sketch_estimate("sketch").alias("approx_unique_count"),
        *(F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(k) for k, q in QUANTILES.items()),
        M.bins_of(F.col("histogram")).alias("histogram"),
        F.transform("sample", lambda s: s["v"]).alias("sample"),
    )


def put_batch(df: DataFrame, batch_id: int, table_name: str, path: str, columns: list[str] | None = None, key: Column | None = None) -> None:
    """Write a batch's partials in the partition of its id, replacing any earlier try."""
    rows = partial_state(df, columns, key).select(F.lit(table_name).alias("table_name"), "*", F.lit(batch_id).cast("bigint").alias("batch_id"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name", "batch_id").parquet(path)


def running_profile(stream: DataFrame, table_name: str, path: str, checkpoint: str, columns: list[str] | None = None, key: Column | None = None, **trigger) -> StreamingQuery:
    """Start a query that keeps the state table of a stream up to date."""
    put = lambda df, batch_id: put_batch(df, batch_id, table_name, path, columns, key)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_profile(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """The profile so far: partials of all batches, merged."""
    states = spark.read.parquet(path).filter(F.col("table_name") == table_name)
    return profile_of_state(merge_states(states))


def compact_state(spark: SparkSession, path: str, into: str) -> None:
    """Write the state table to another folder with all batches but the last of each table merged to one, numbered -1.

    A stream goes on with the new folder: it may deliver its last batch again, which then replaces its
    rows as before. The old folder stays as it is, so a failed compaction loses nothing.
    """
    states = spark.read.parquet(path)
    last = F.broadcast(states.groupBy("table_name").agg(F.max("batch_id").alias("_last")))
    marked = states.join(last, "table_name")
    merged = merge_states(marked.filter("batch_id < _last"), ("table_name", "column_name")).withColumn("batch_id", F.lit(-1).cast("bigint"))
    kept = marked.filter("batch_id = _last").select(*merged.columns)
    merged.unionByName(kept).repartition("table_name", "batch_id").write.partitionBy("table_name", "batch_id").parquet(into)

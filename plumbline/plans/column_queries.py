"""Column profiles of the standard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.types import NA_TOKENS, missing_to_null
from plumbline.operators import columns as C
from plumbline.plans.registry import query
from plumbline.session import table

INT, FLOAT, DATE, TEXT, BOOL = "sc:Integer", "sc:Float", "sc:Date", "sc:Text", "bool"

LINEITEM = {
    "l_orderkey": INT, "l_partkey": INT, "l_suppkey": INT, "l_linenumber": INT, "l_quantity": FLOAT, "l_extendedprice": FLOAT,
    "l_discount": FLOAT, "l_tax": FLOAT, "l_returnflag": TEXT, "l_linestatus": TEXT, "l_shipdate": DATE,
}
ORDERS = {"o_orderkey": INT, "o_custkey": INT, "o_orderstatus": TEXT, "o_totalprice": FLOAT, "o_orderdate": DATE, "o_orderpriority": TEXT}
EVENTS = {"event_id": INT, "ts": DATE, "user_id": INT, "event_type": TEXT, "value": FLOAT, "props": TEXT}
CUSTOMER_TEXT = {"c_name": TEXT, "c_mktsegment": TEXT}
MEASURES = ("mean", "variance", "standard_deviation", "missing_percentage")
QUANTITIES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def f32(c: str) -> Column:
    """Single precision: sums in another order agree in it."""
    return F.col(c).cast("float").cast("double").alias(c)


def compared(profile: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    keep = ["column_name", "data_type", "row_count", "missing_count", *MEASURES, "min_value", "max_value", "range_value", "unique_count"]
    return profile.select(*(f32(c) if c in MEASURES or c == "range_value" else c for c in keep if c not in drop))


def sql_profile(source: str, kinds: dict[str, str]) -> str:
    parts = []
    for c, kind in kinds.items():
        x = f"{c}::INT::DOUBLE" if kind == BOOL else f"{c}::DOUBLE"
        measures = (("mean", f"avg({x})"), ("variance", f"var_samp({x})"), ("standard_deviation", f"stddev_samp({x})"))
        numbers = [f"({e})::FLOAT::DOUBLE AS {n}" for n, e in measures] + [f"min({x}) AS min_value", f"max({x}) AS max_value", f"(max({x}) - min({x}))::FLOAT::DOUBLE AS range_value"]
        nulls = [f"NULL::DOUBLE AS {n}" for n in ("mean", "variance", "standard_deviation", "min_value", "max_value", "range_value")]
        parts.append(
            f"SELECT '{c}' AS column_name, '{FLOAT if kind == BOOL else kind}' AS data_type, count({c}) AS row_count, count(*) - count({c}) AS missing_count,"
            f" ((count(*) - count({c})) / count(*) * 100)::FLOAT::DOUBLE AS missing_percentage, {', '.join(numbers if kind in (INT, FLOAT, BOOL) else nulls)},"
            f" count(DISTINCT {c}) AS unique_count FROM {source}"
        )
    return " UNION ALL ".join(parts)


def counts_only(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts, moments and distinct values, as ``profile_columns`` has them, without histograms."""
    full = C.column_counts(df, columns).join(F.broadcast(C.unique_counts(df, columns)), "column_name", "left")
    missing = F.col("total") - F.col("row_count")
    return full.select(
        "column_name", "data_type", "row_count", missing.alias("missing_count"), (missing / F.col("total") * 100).alias("missing_percentage"), "mean", "variance",
        F.sqrt("variance").alias("standard_deviation"), "min_value", "max_value", (F.col("max_value") - F.col("min_value")).alias("range_value"), "unique_count",
    )


@query("column_profile_lineitem", sql_profile("lineitem", LINEITEM))
def column_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(C.profile_columns(table(spark, sf_dir, "lineitem"), list(LINEITEM)))


@query("column_profile_orders", sql_profile("orders", ORDERS))
def column_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(counts_only(table(spark, sf_dir, "orders"), list(ORDERS)))


@query("column_profile_events", sql_profile("events", EVENTS))
def column_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(C.profile_columns(table(spark, sf_dir, "events"), list(EVENTS)))


@query("text_column_profile_customer", sql_profile("customer", CUSTOMER_TEXT))
def text_column_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(counts_only(table(spark, sf_dir, "customer"), list(CUSTOMER_TEXT)))


@query(
    "missing_profile",
    sql_profile(
        "(SELECT nullif(l_discount, 0.0) AS discount, nullif(l_returnflag, 'N') AS returnflag, nullif(l_linenumber, 1) AS linenumber FROM lineitem)",
        {"discount": FLOAT, "returnflag": TEXT, "linenumber": INT},
    ),
)
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr("nullif(l_discount, 0.0D) AS discount", "nullif(l_returnflag, 'N') AS returnflag", "nullif(l_linenumber, 1) AS linenumber")
    return compared(C.profile_columns(df))


@query("boolean_column_profile", sql_profile("(SELECT l_quantity > 25 AS large, CASE WHEN l_tax > 0.02 THEN l_discount > 0.05 END AS cheap FROM lineitem)", {"large": BOOL, "cheap": BOOL}))
def boolean_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr("l_quantity > 25 AS large", "CASE WHEN l_tax > 0.02D THEN l_discount > 0.05D END AS cheap")
    return compared(C.profile_columns(df))


@query(
    "allnull_constant_profile",
    sql_profile("(SELECT NULL::DOUBLE AS nothing, 7::BIGINT AS seven, 0.0::DOUBLE AS zero, nullif(o_orderkey, o_orderkey)::BIGINT AS none FROM orders)", {"nothing": FLOAT, "seven": INT, "zero": FLOAT, "none": INT}),
)
def allnull_constant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr("CAST(NULL AS DOUBLE) AS nothing", "7L AS seven", "0.0D AS zero", "nullif(o_orderkey, o_orderkey) AS none")
    return compared(C.profile_columns(df))


def sql_bins(source: str, c: str) -> str:
    inner = " + ".join(f"(lo + {i} * ((hi - lo) / 10.0::DOUBLE) < x)::INT" for i in range(1, 10))
    return f"""SELECT '{c}' AS column_name, g.bin_no::INT AS bin_no,
      (CASE WHEN g.bin_no = 0 AND mn < mx THEN lo - (hi - lo) * 0.001 ELSE lo + g.bin_no * ((hi - lo) / 10.0) END)::FLOAT::DOUBLE AS lo,
      (CASE WHEN g.bin_no = 9 THEN hi ELSE lo + (g.bin_no + 1) * ((hi - lo) / 10.0) END)::FLOAT::DOUBLE AS hi, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(0, 10)) AS bin_no) g,
         (SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx,
                 CASE WHEN min({c}) = max({c}) THEN min({c}) - (CASE WHEN min({c}) = 0 THEN 0.001 ELSE 0.001 * abs(min({c})) END) ELSE min({c}) END::DOUBLE AS lo,
                 CASE WHEN min({c}) = max({c}) THEN max({c}) + (CASE WHEN min({c}) = 0 THEN 0.001 ELSE 0.001 * abs(min({c})) END) ELSE max({c}) END::DOUBLE AS hi FROM {source}) b
    LEFT JOIN (SELECT bin_no, count(*) AS n FROM (SELECT {inner} AS bin_no FROM (SELECT {c}::DOUBLE AS x FROM {source} WHERE {c} IS NOT NULL) v,
         (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - (CASE WHEN min({c}) = 0 THEN 0.001 ELSE 0.001 * abs(min({c})) END) ELSE min({c}) END::DOUBLE AS lo,
                 CASE WHEN min({c}) = max({c}) THEN max({c}) + (CASE WHEN min({c}) = 0 THEN 0.001 ELSE 0.001 * abs(min({c})) END) ELSE max({c}) END::DOUBLE AS hi FROM {source}) e)
         GROUP BY bin_no) h ON h.bin_no = g.bin_no"""


def sql_histogram(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(sql_bins(source, c) for c in names)


@query("histogram_lineitem", sql_histogram("lineitem", QUANTITIES))
def histogram_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram_counts(table(spark, sf_dir, "lineitem"), QUANTITIES).select("column_name", "bin_no", f32("lo"), f32("hi"), "n")


@query("histogram_edge_cases", sql_histogram("(SELECT nullif(o_custkey, 1) AS custkey, 7::BIGINT AS seven, 0.0::DOUBLE AS zero FROM orders)", ["custkey", "seven", "zero"]))
def histogram_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr("nullif(o_custkey, 1) AS custkey", "7L AS seven", "0.0D AS zero")
    return C.histogram_counts(df).select("column_name", "bin_no", f32("lo"), f32("hi"), "n")


def _sql_hist_quantiles(source: str, names: list[str]) -> str:
    qs = " UNION ALL ".join(f"SELECT '{k}' AS k, {q}::DOUBLE AS q" for k, q in C.QUANTILES.items())
    raw = sql_histogram(source, names).replace("::FLOAT::DOUBLE AS lo", "::DOUBLE AS lo").replace("::FLOAT::DOUBLE AS hi", "::DOUBLE AS hi")
    bounds = " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {source}" for c in names)
    return f"""
WITH h AS ({raw}), b AS ({bounds}), qs AS ({qs}),
r AS (SELECT *, sum(n) OVER (PARTITION BY column_name ORDER BY bin_no) AS cum, sum(n) OVER (PARTITION BY column_name) AS total FROM h),
f AS (SELECT column_name, k, arg_min(least(greatest(lo + (q * total - (cum - n)) / n * (hi - lo), mn), mx), bin_no) AS v
      FROM r JOIN b USING (column_name), qs WHERE n > 0 AND cum >= q * total GROUP BY column_name, k)
SELECT column_name, max(CASE WHEN k = 'percentile05' THEN v END)::FLOAT::DOUBLE AS percentile05, max(CASE WHEN k = 'median' THEN v END)::FLOAT::DOUBLE AS median,
       max(CASE WHEN k = 'percentile95' THEN v END)::FLOAT::DOUBLE AS percentile95 FROM f GROUP BY column_name"""


@query("histogram_quantiles", _sql_hist_quantiles("lineitem", QUANTITIES))
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.profile_columns(table(spark, sf_dir, "lineitem"), QUANTITIES, distinct="approx")
    return p.select("column_name", *map(f32, C.QUANTILES))


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, " + ", ".join(f"quantile_cont({c}::DOUBLE, {q})::FLOAT::DOUBLE AS {k}" for k, q in C.QUANTILES.items()) + " FROM lineitem" for c in QUANTITIES
    ),
)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_quantiles(table(spark, sf_dir, "lineitem"), QUANTITIES).select("column_name", *map(f32, C.QUANTILES))


@query(
    "refined_quantiles",
    " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, quantile_cont(l_extendedprice::DOUBLE, {q})::FLOAT::DOUBLE AS value FROM lineitem" for q in (0.05, 0.5, 0.95)),
)
def refined_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.refined_quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], few=5_000)
    return got.select(F.col("q").cast("double").alias("q"), f32("value"))


@query(
    "width_bucket_histogram",
    """
WITH b AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem)
SELECT bucket, ((bucket - 1) * ((mx - mn) / 10) + mn)::FLOAT::DOUBLE AS lo, (bucket * ((mx - mn) / 10) + mn)::FLOAT::DOUBLE AS hi, count(*) AS n
FROM (SELECT mn, mx, CASE WHEN x >= mx THEN 11 ELSE floor(10 * (x - mn) / (mx - mn))::BIGINT + 1 END AS bucket FROM (SELECT l_extendedprice AS x FROM lineitem) v, b)
GROUP BY bucket, mn, mx""",
)
def width_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.width_bucket_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bucket", f32("lo"), f32("hi"), "n")


@query(
    "histogram_json",
    f"""SELECT column_name, '[' || string_agg('{{"bin":' || bin_no || ',"count":' || n || '}}', ',' ORDER BY bin_no) || ']' AS histogram
FROM ({sql_histogram('lineitem', ['l_quantity', 'l_tax'])}) GROUP BY column_name""",
)
def histogram_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = C.histogram_arrays(C.histogram_counts(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]))
    plain = F.transform("histogram", lambda b, i: F.struct(i.alias("bin"), b["count"].alias("count")))
    return arrays.select("column_name", F.to_json(plain).alias("histogram"))


@query(
    "value_sample",
    "WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(event_id::VARCHAR)) AS rank FROM events)"
    + " UNION ALL ".join(f" SELECT '{c}' AS column_name, rank::INT AS rank, {c}::VARCHAR AS value FROM s WHERE rank <= 10" for c in ("user_id", "event_type", "props")),
)
def value_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.value_sample(table(spark, sf_dir, "events"), F.md5(F.col("event_id").cast("string")), ["user_id", "event_type", "props"])


@query(
    "distinct_value_sample",
    "SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM (SELECT DISTINCT o_orderpriority FROM (SELECT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1000) WHERE o_orderpriority IS NOT NULL) ORDER BY value LIMIT 3",
)
def distinct_value_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distinct_value_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query(
    "table_examples",
    "WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 30)"
    + " UNION ALL ".join(f" SELECT '{c}' AS column_name, to_json(list({c} ORDER BY o_orderkey))::VARCHAR AS examples FROM f" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
)
def table_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_examples(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def _sql_votes(source: str, names: list[str]) -> str:
    out = []
    for c in names:
        counts = ", ".join(f"count(*) FILTER (regexp_matches({c}, '{p}')) AS {n}" for n, p in (("f", r"^[+-]?\d+\.\d+$"), ("i", r"^[+-]?\d+$"), ("d", r"^\d{4}-\d{2}-\d{2}$")))
        out.append(
            f"SELECT '{c}' AS column_name, CASE WHEN greatest(f, i, d) = 0 THEN 'sc:Text' WHEN f = greatest(f, i, d) THEN 'sc:Float' WHEN i = greatest(f, i, d) THEN 'sc:Integer' ELSE 'sc:Date' END AS data_type"
            f" FROM (SELECT {counts} FROM {source})"
        )
    return " UNION ALL ".join(out)


_AS_TEXT = "(SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%d') AS day, event_type, (user_id % 7)::VARCHAR || '.' || (event_id % 100)::VARCHAR AS ratio, CASE WHEN event_id % 3 = 0 THEN (-user_id)::VARCHAR ELSE props END AS mixed FROM events)"


@query("infer_types_events", _sql_votes(_AS_TEXT, ["event_id", "day", "event_type", "ratio", "mixed"]))
def infer_types_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(
        "cast(event_id AS string) AS event_id", "date_format(ts, 'yyyy-MM-dd') AS day", "event_type",
        "concat(user_id % 7, '.', event_id % 100) AS ratio", "CASE WHEN event_id % 3 = 0 THEN cast(-user_id AS string) ELSE props END AS mixed",
    )
    return C.infer_types(df)


_NA_LIST = ", ".join(f"'{t}'" for t in NA_TOKENS)
_WITH_TOKENS = "CASE WHEN user_id % 5 = 0 THEN 'NA' WHEN user_id % 5 = 1 THEN '' WHEN user_id % 5 = 2 THEN 'n/a' ELSE event_type END"


@query("na_token_cleanup", f"SELECT event_id, CASE WHEN raw NOT IN ({_NA_LIST}) THEN raw END AS value FROM (SELECT event_id, {_WITH_TOKENS} AS raw FROM events)")
def na_token_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{_WITH_TOKENS} AS raw")
    return df.select("event_id", missing_to_null(F.col("raw")).alias("value"))


@query(
    "multi_table_profile",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({sql_profile(t, k)})" for t, k in (("orders", ORDERS), ("supplier", {"s_suppkey": INT, "s_name": TEXT, "s_nationkey": INT, "s_acctbal": FLOAT}))),
)
def multi_table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.profile_tables({t: table(spark, sf_dir, t) for t in ("orders", "supplier")}, distinct="exact")
    keep = ["table_name", "column_name", "data_type", "row_count", "missing_count", *MEASURES, "min_value", "max_value", "range_value", "unique_count"]
    return got.select(*(f32(c) if c in MEASURES or c == "range_value" else c for c in keep))

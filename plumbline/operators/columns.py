"""Column profiles: counts, moments, distinct values, histograms, quantiles, samples, types.

One wide aggregate gives the counts and moments of all columns in one scan, a second the bins of
all histograms once the bounds are known; each returns a few values per column, which
are then turned to one row per column. Exact distinct counts are an aggregate of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.functions.types import is_nested, is_numeric, semantic_type, votes, winner

BINS = 10
SAMPLE_SIZE = 10
#: Beyond this many distinct values a count is flagged as large; it is not cut off.
UNIQUE_FLAG = 100_000
#: Columns in one aggregate: more would outgrow the size limit of generated code.
BATCH = 40


def field_types(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, T.DataType]]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [(c, kinds[c]) for c in columns or df.columns]


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present(name: str, kind: T.DataType) -> Column:
    """The column with NaN as null."""
    c = column(name)
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def number(name: str, kind: T.DataType) -> Column:
    c = present(name, kind)
    return (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("double")


def batches(items: list, size: int = BATCH) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def rows_of(wide: DataFrame, prefixes: list[str], fields: dict[str, str]) -> DataFrame:
    """One row for each prefix of a one-row frame whose columns are prefix + field; missing ones are null."""
    have = set(wide.columns)
    part = lambda p, f, kind: (F.col(f"{p}{f}") if f"{p}{f}" in have else F.lit(None)).cast(kind).alias(f)
    return wide.select(F.inline(F.array(*(F.struct(*(part(p, f, k) for f, k in fields.items())) for p in prefixes))))


COUNTS = {
    "column_name": "string", "position": "int", "data_type": "string", "total": "bigint", "row_count": "bigint", "mean": "double", "variance": "double",
    "min_value": "double", "max_value": "double", "is_numeric": "boolean", "is_boolean": "boolean",
}


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts, moments and bounds of each column: one scan, partial sums only are shuffled."""
    kinds = field_types(df, columns)
    out = []
    for batch in batches(list(enumerate(kinds))):
        aggs = [F.count(F.lit(1)).alias("total")]
        for i, (name, kind) in batch:
            aggs.append(F.count(present(name, kind)).alias(f"c{i}_row_count"))
            if is_numeric(kind):
                x = number(name, kind)
                aggs += [F.avg(x).alias(f"c{i}_mean"), F.var_samp(x).alias(f"c{i}_variance"), F.min(x).alias(f"c{i}_min_value"), F.max(x).alias(f"c{i}_max_value")]
        wide = df.agg(*aggs)
        facts = {}
        for i, (name, kind) in batch:
            facts |= {
                f"c{i}_column_name": F.lit(name), f"c{i}_position": F.lit(i), f"c{i}_data_type": F.lit(semantic_type(kind)), f"c{i}_total": F.col("total"),
                f"c{i}_is_numeric": F.lit(is_numeric(kind)), f"c{i}_is_boolean": F.lit(isinstance(kind, T.BooleanType)),
            }
        out.append(rows_of(wide.withColumns(facts), [f"c{i}_" for i, _ in batch], COUNTS))
    return reduce(DataFrame.unionByName, out)


def unique_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, unique_count): exact, or by HyperLogLog in the memory of one sketch per column.

    The exact count reduces each column to its distinct values before anything is shuffled.
    Nested columns have none.
    """
    kinds = [(n, k) for n, k in (field_types(df, columns) if columns != [] else []) if not is_nested(k)]
    if not kinds:
        return df.sparkSession.createDataFrame([], "column_name string, unique_count bigint")
    count = F.approx_count_distinct if approximate else F.count_distinct
    out = []
    for batch in batches(list(enumerate(kinds)), BATCH if approximate else 16):
        wide = df.agg(*(count(present(n, k)).alias(f"c{i}_unique_count") for i, (n, k) in batch))
        wide = wide.withColumns({f"c{i}_column_name": F.lit(n) for i, (n, _) in batch})
        out.append(rows_of(wide, [f"c{i}_" for i, _ in batch], {"column_name": "string", "unique_count": "bigint"}))
    return reduce(DataFrame.unionByName, out)


def budgeted_counts(df: DataFrame, columns: list[str] | None = None, budget: int = UNIQUE_FLAG) -> DataFrame:
    """(column_name, unique_count, unique_is_estimate): exact for columns that have at most ``budget`` distinct values by estimate."""
    estimates = {r["column_name"]: r["unique_count"] for r in unique_counts(df, columns, True).collect()}  # a number for each column
    large = [c for c, n in estimates.items() if n > budget]
    exact = unique_counts(df, [c for c in estimates if c not in large]).withColumn("unique_is_estimate", F.lit(False))
    rest = df.sparkSession.createDataFrame([(c, estimates[c], True) for c in large], "column_name string, unique_count bigint, unique_is_estimate boolean")
    return exact.unionByName(rest)


def edge(lo: Column, hi: Column, i: Column | int, bins: int = BINS) -> Column:
    return lo + i * ((hi - lo) / F.lit(float(bins)))


def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    """The range to cut: a single value gets a thousandth of itself on either side."""
    pad = F.when(lo == 0, 0.001).otherwise(0.001 * F.abs(lo))
    return F.when(lo == hi, lo - pad).otherwise(lo), F.when(lo == hi, hi + pad).otherwise(hi)


def bin_number(x: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """How many inner edges lie under x: bins are closed on the right. Compares, as division would move ties."""
    return reduce(Column.__add__, [(edge(lo, hi, i, bins) < x).cast("int") for i in range(1, bins)])


def histogram_counts(df: DataFrame, columns: list[str] | None = None, bins: int = BINS, bounds_of: dict[str, tuple] | None = None) -> DataFrame:
    """(column_name, bin_no, lo, hi, n): equal-width bins of each numeric column, empty ones too.

    Bounds come from one aggregate (or are given, by column) whose single row is broadcast; the second scan sends
    (column, bin, partial count) only. A column without values has no bins. The first edge is
    lowered by a thousandth of the range.
    """
    kinds = [(n, k) for n, k in field_types(df, columns) if is_numeric(k)]
    if not kinds:
        return df.sparkSession.createDataFrame([], "column_name string, bin_no int, lo double, hi double, n bigint")
    out = []
    for batch in batches(kinds):
        if bounds_of is None:
            bounds = df.agg(*(f(number(n, k)).alias(f"{a}{i}") for i, (n, k) in enumerate(batch) for a, f in (("mn", F.min), ("mx", F.max))))
        else:
            ends = [v for n, _ in batch for v in bounds_of[n]]
            bounds = df.sparkSession.createDataFrame([ends], ", ".join(f"mn{i} double, mx{i} double" for i in range(len(batch))))
        cuts = {}
        for i in range(len(batch)):
            cuts[f"lo{i}"], cuts[f"hi{i}"] = widened(F.col(f"mn{i}"), F.col(f"mx{i}"))
        bounds = bounds.withColumns(cuts)
        values = df.select(*(number(n, k).alias(f"x{i}") for i, (n, k) in enumerate(batch))).crossJoin(F.broadcast(bounds.select(*cuts)))
        bin_of = [F.struct(F.lit(i).alias("c"), bin_number(F.col(f"x{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), bins).alias("bin_no")) for i in range(len(batch))]
        counted = values.select(F.inline(F.array(*bin_of))).filter("bin_no is not null").groupBy("c", "bin_no").agg(F.count(F.lit(1)).alias("n"))
        fields = {"column_name": "string", "c": "int", "lo": "double", "hi": "double", "mn": "double", "mx": "double"}
        named = bounds.withColumns({f"c{i}_{k}": (F.lit(n) if k == "column_name" else F.lit(i) if k == "c" else F.col(f"{k}{i}")) for i, (n, _) in enumerate(batch) for k in fields})
        grid = rows_of(named, [f"c{i}_" for i in range(len(batch))], fields).filter("lo is not null")
        grid = grid.withColumn("bin_no", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        lo, hi, b = F.col("lo"), F.col("hi"), F.col("bin_no")
        first = (b == 0) & (F.col("mn") < F.col("mx"))
        left = F.when(first, lo - (hi - lo) * 0.001).otherwise(edge(lo, hi, b, bins))
        right = F.when(b == bins - 1, hi).otherwise(edge(lo, hi, b + 1, bins))
        grid = grid.select("column_name", "c", "bin_no", left.alias("lo"), right.alias("hi"))
        out.append(grid.join(counted, ["c", "bin_no"], "left").select("column_name", "bin_no", "lo", "hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, out)


def histogram_arrays(bins: DataFrame) -> DataFrame:
    """(column_name, histogram): the bins of each column as one array in order."""
    item = F.struct("bin_no", "lo", "hi", F.col("n").alias("count"))
    arrays = bins.groupBy("column_name").agg(F.sort_array(F.collect_list(item)).alias("h"))
    return arrays.select("column_name", F.transform("h", lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["count"].alias("count"))).alias("histogram"))


def histogram_quantile(histogram: Column, q: float, lo: Column, hi: Column) -> Column:
    """Linear interpolation in the first bin that reaches q of all values, kept within lo..hi."""
    total = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda a, b: a + b["count"])
    zero = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("at"))

    def step(a: Column, b: Column) -> Column:
        target, n = F.lit(q) * total, b["count"]
        here = a["at"].isNull() & (n > 0) & (a["seen"] + n >= target)
        at = F.when(here, b["lo"] + (target - a["seen"]) / n * (b["hi"] - b["lo"])).otherwise(a["at"])
        return F.struct((a["seen"] + n).alias("seen"), at.alias("at"))

    found = F.aggregate(histogram, zero, step, lambda a: a["at"])
    return F.when(lo == hi, lo).otherwise(F.least(F.greatest(F.coalesce(found, hi), lo), hi))


QUANTILES = {"percentile05": 0.05, "median": 0.5, "percentile95": 0.95}


def exact_quantiles(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(column_name, percentile05, median, percentile95), linearly interpolated.

    Exact ones of any size of column come by ``refined_quantiles``; ``approximate`` takes one scan with a sketch.
    """
    kinds = [(n, k) for n, k in field_types(df, columns) if is_numeric(k)]
    if not kinds:
        return df.sparkSession.createDataFrame([], "column_name string, percentile05 double, median double, percentile95 double")
    if not approximate:
        long = refined_quantiles(df, [n for n, _ in kinds], tuple(QUANTILES.values()))
        return long.groupBy("column_name").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(k) for k, q in QUANTILES.items()))
    qs = F.array(*map(F.lit, QUANTILES.values()))
    out = []
    for batch in batches(list(enumerate(kinds))):
        wide = df.agg(*(F.percentile_approx(number(n, k), qs, accuracy).alias(f"q{i}") for i, (n, k) in batch))
        wide = wide.select(*(e for i, (n, _) in batch for e in (F.lit(n).alias(f"c{i}_column_name"), *(F.col(f"q{i}")[j].alias(f"c{i}_{q}") for j, q in enumerate(QUANTILES)))))
        out.append(rows_of(wide, [f"c{i}_" for i, _ in batch], {"column_name": "string"} | dict.fromkeys(QUANTILES, "double")))
    return reduce(DataFrame.unionByName, out)


#: Values of a band, at most, whose exact quantile one task takes; a larger band is narrowed by another sketch.
FEW = 250_000


@dataclass
class _Band:
    """Where a wanted rank lies: among ``n`` values from ``lo`` to ``hi``, with ``below`` values under them; None is open."""

    column: str
    x: Column
    q: float
    at: float
    n: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    stuck: bool = False

    def values(self, lo: float | None, hi: float | None) -> Column:
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (self.x >= lo)
        if hi is not None:
            inside = inside & (self.x <= hi)
        return F.when(inside, self.x)


def refined_quantiles(df: DataFrame, names: list[str], qs: tuple[float, ...] = (0.05, 0.5, 0.95), few: int = FEW, accuracy: int = 10_000) -> DataFrame:
    """(column_name, q, value): exact quantiles, linearly interpolated, of columns of any size.

    A sketch gives two values between which a wanted rank lies, and a scan counts what is under and between them. If more
    than ``few`` values are between, that is done again within them: each round leaves some thousandth.
    In the end a task takes the exact quantile of a few values. A round is two scans for all columns and
    quantiles; a column without values has nulls. The driver holds a few numbers for each quantile.
    """
    kinds = dict(field_types(df))
    counts = df.agg(*(F.count(number(n, kinds[n])).alias(f"n{i}") for i, n in enumerate(names))).collect()[0]
    bands = [_Band(n, number(n, kinds[n]), q, q * (counts[i] - 1), counts[i]) for i, n in enumerate(names) for q in qs]
    slack = 2 / accuracy
    while wide := [b for b in bands if b.n > few and not b.stuck]:
        shares = [(b.at - b.below) / (b.n - 1) for b in wide]
        ends = [F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))) for p in shares]
        cuts = df.agg(*(F.percentile_approx(b.values(b.lo, b.hi), e, accuracy).alias(f"c{i}") for i, (b, e) in enumerate(zip(wide, ends, strict=True)))).collect()[0]
        sums = [
            e
            for i, b in enumerate(wide)
            for e in (F.count_if(b.x < cuts[i][0]).alias(f"u{i}"), F.count_if(b.x <= cuts[i][0]).alias(f"v{i}"), F.count_if(b.x < cuts[i][1]).alias(f"w{i}"), F.count_if(b.x <= cuts[i][1]).alias(f"z{i}"))
        ]
        seen = df.agg(*sums).collect()[0]
        for i, b in enumerate(wide):
            (lo, hi), under, upto, under_hi, upto_hi = cuts[i], *(seen[f"{k}{i}"] for k in "uvwz")
            first, last = math.floor(b.at), math.ceil(b.at)
            if under > first or upto_hi <= last:
                slack *= 8  # the sketch has missed the rank; next time further off
            elif last < upto:
                b.lo, b.hi, b.n = lo, lo, 1  # all the same value
            elif first >= under_hi:
                b.lo, b.hi, b.n = hi, hi, 1
            else:
                b.stuck = upto_hi - under == b.n  # many equal values at both ends: few different ones between
                b.lo, b.hi, b.below, b.n = lo, hi, under, upto_hi - under
    share = lambda b: 0.0 if b.n < 2 else (b.at - b.below) / (b.n - 1)
    found = df.agg(*((F.percentile(b.values(b.lo, b.hi), F.lit(share(b))) if b.lo is None or b.lo < b.hi else F.lit(b.lo)).alias(f"v{i}") for i, b in enumerate(bands)))
    rows = [F.struct(F.lit(b.column).alias("column_name"), F.lit(b.q).alias("q"), F.col(f"v{i}").cast("double").alias("value")) for i, b in enumerate(bands)]
    return found.select(F.inline(F.array(*rows)))


def generated_at() -> Column:
    """When the query runs, in UTC, as ISO 8601; the same for all rows."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def profile_columns(
    df: DataFrame, columns: list[str] | None = None, distinct: str = "exact", quantiles: str = "histogram", bins: int = BINS, scan_limit: int | None = None
) -> DataFrame:
    """One row per column with all measures, in column order.

    ``distinct``: exact, approx, or budget: exact for columns of up to ``UNIQUE_FLAG`` distinct values by
    estimate, the estimate for others; ``unique_is_estimate`` tells. ``quantiles``: histogram (from the bins), exact, or approx.
    ``scan_limit`` profiles the first rows only. Measures that don't apply are null: numbers
    for text, dates and nested columns, percentiles for booleans, variance for a single value;
    an all-null numeric column has an empty histogram and no distinct values; an empty table
    has no measures at all. Counts and bounds are taken at once, when the profile is set up.
    """
    if scan_limit is not None:
        df = df.limit(scan_limit)
    found = column_counts(df, columns).collect()  # a row for each column
    counts = df.sparkSession.createDataFrame(found, ", ".join(f"{c} {k}" for c, k in COUNTS.items()))
    ends = {r["column_name"]: (r["min_value"], r["max_value"]) for r in found}
    uniques = budgeted_counts(df, columns) if distinct == "budget" else unique_counts(df, columns, distinct == "approx").withColumn("unique_is_estimate", F.lit(distinct == "approx"))
    full = counts.join(F.broadcast(uniques), "column_name", "left").join(F.broadcast(histogram_arrays(histogram_counts(df, columns, bins, ends))), "column_name", "left")
    lo, hi = F.col("min_value"), F.col("max_value")
    some = F.col("total") > 0
    if quantiles == "histogram":
        full = full.withColumns({k: histogram_quantile(F.col("histogram"), q, lo, hi) for k, q in QUANTILES.items()})
    else:
        full = full.join(F.broadcast(exact_quantiles(df, columns, quantiles == "approx")), "column_name", "left")
    no_percentile = F.col("is_boolean")
    empty = F.array().cast("array<struct<lo:double,hi:double,count:bigint>>")
    missing = F.col("total") - F.col("row_count")
    return full.select(
        "column_name",
        "position",
        "data_type",
        F.when(some, F.col("row_count")).alias("row_count"),
        "mean",
        "median",
        F.sqrt("variance").alias("standard_deviation"),
        "min_value",
        "max_value",
        F.when(some, missing).alias("missing_count"),
        F.when(some, missing / F.col("total") * 100).alias("missing_percentage"),
        F.when(some & F.col("is_numeric"), F.coalesce("histogram", empty)).alias("histogram"),
        F.when(some, F.col("unique_count")).alias("unique_count"),
        (F.col("unique_count") > UNIQUE_FLAG).alias("unique_is_large"),
        F.when(some, F.col("unique_is_estimate")).alias("unique_is_estimate"),
        "variance",
        (hi - lo).alias("range_value"),
        F.when(~no_percentile, F.col("percentile05")).alias("percentile05"),
        F.when(~no_percentile, F.col("percentile95")).alias("percentile95"),
        generated_at().alias("generated_at"),
    )


def width_bucket_histogram(df: DataFrame, name: str, bins: int = BINS) -> DataFrame:
    """(bucket, lo, hi, n) of the non-empty left-closed buckets; the maximum is in one of its own after the last."""
    x = df.select(column(name).cast("double").alias("x"))
    bounds = x.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    got = x.filter("x is not null").crossJoin(F.broadcast(bounds)).select("mn", "mx", F.width_bucket("x", "mn", "mx", F.lit(bins)).alias("bucket"))
    step = (F.col("mx") - F.col("mn")) / bins
    lo, hi = (F.col("bucket") - 1) * step + F.col("mn"), F.col("bucket") * step + F.col("mn")
    return got.groupBy("bucket", "mn", "mx").agg(F.count(F.lit(1)).alias("n")).select("bucket", lo.alias("lo"), hi.alias("hi"), "n")


def value_sample(df: DataFrame, key: Column, columns: list[str] | None = None, size: int = SAMPLE_SIZE) -> DataFrame:
    """(column_name, rank, value): the values, nulls too, of the ``size`` rows of smallest key in each column.

    ``key`` should be a hash of the row's own key; the sample is then uniform and the same in every run.
    """
    names = columns or df.columns
    picked = df.select(key.alias("_k"), *(column(n).cast("string").alias(f"v{i}") for i, n in enumerate(names)))
    first = picked.orderBy("_k").limit(size)  # a top-k per task, then of those
    ranked = first.withColumn("rank", F.row_number().over(W.orderBy("_k")))
    pairs = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"v{i}").alias("value")) for i, n in enumerate(names)))
    return ranked.select("rank", F.inline(pairs)).select("column_name", "rank", "value")


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, data_type): from the schema, and for text by a vote of all values; ties go to float, integer, date."""
    kinds = field_types(df, columns)
    wide = df.agg(*(v.alias(f"c{i}_{n}") for i, (name, k) in enumerate(kinds) if semantic_type(k) == "sc:Text" and not is_nested(k) for v, n in zip(votes(column(name).cast("string")), ("floats", "ints", "dates"), strict=True)), F.count(F.lit(1)).alias("total"))
    kind = lambda i, k: winner(F.col(f"c{i}_floats"), F.col(f"c{i}_ints"), F.col(f"c{i}_dates")) if f"c{i}_floats" in wide.columns else F.lit(semantic_type(k))
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), kind(i, k).alias("data_type")) for i, (n, k) in enumerate(kinds)))
    return wide.select(F.inline(rows))


def distinct_value_sample(df: DataFrame, name: str, key: str, size: int = 3, scan: int = 1000) -> DataFrame:
    """(column_name, value): the first ``size`` different values among the first ``scan`` rows by key."""
    first = df.select(column(key).alias("_k"), column(name).alias("value")).orderBy("_k").limit(scan)
    values = first.select("value").filter("value is not null").distinct().orderBy("value").limit(size)
    return values.select(F.lit(name).alias("column_name"), F.col("value").cast("string"))


def table_examples(df: DataFrame, key: str, columns: list[str] | None = None, rows: int = 30) -> DataFrame:
    """(column_name, examples): a JSON array of the column's values in the first rows by key; NaN is null."""
    kinds = field_types(df, columns)
    first = df.select(column(key).alias("_k"), *(present(n, k).alias(f"v{i}") for i, (n, k) in enumerate(kinds))).orderBy("_k").limit(rows)
    packed = first.agg(F.sort_array(F.collect_list(F.struct("_k", *(f"v{i}" for i in range(len(kinds)))))).alias("r"))
    json = lambda i: F.to_json(F.transform("r", lambda x: x[f"v{i}"]), {"ignoreNullFields": "false"})
    return packed.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column_name"), json(i).alias("examples")) for i, (n, _) in enumerate(kinds)))))


def profile_tables(tables: dict[str, DataFrame], **options) -> DataFrame:
    """The profiles of several tables of one source, by name; tables without columns are left out."""
    parts = [profile_columns(df, **options).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items() if df.columns]
    return reduce(DataFrame.unionByName, parts)

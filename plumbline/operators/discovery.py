"""Keys and references that nobody has declared, found from values; and join paths between tables.

Sketches say what can't be: counting and joining of values is done only for column sets and pairs that they leave. What is driven by the
driver is metadata, a few numbers for each column.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.types import is_nested
from plumbline.operators.columns import BATCH, batches, column, field_types
from plumbline.session import scratch_dir

#: Standard error of distinct counts, and how many of it an estimate is trusted within.
ERROR, SIGMAS = 0.02, 6
#: Hashes of a column's values that a sketch has, at the average.
HASHES = 1024

KEYS = "table_name string, columns array<string>, total bigint, uniques bigint"
REFERENCES = "table_name string, column_name string, foreign_table string, foreign_column string, missing bigint, used bigint, coverage double"


def _rows_as(names: tuple[str, ...]) -> Column:
    return column(names[0]) if len(names) == 1 else F.struct(*map(column, names))


def _all_present(names: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [column(c).isNotNull() for c in names])


def _counts(df: DataFrame, sets: list[tuple[str, ...]], exact: bool) -> dict[tuple[str, ...], int]:
    """Distinct rows of each set of columns among those without nulls, many sets in a scan."""
    out = {}
    for batch in batches(sets, 8 if exact else BATCH):
        count = (lambda c: F.count_distinct(c)) if exact else (lambda c: F.approx_count_distinct(c, ERROR))
        got = df.agg(*(count(F.when(_all_present(s), _rows_as(s))).alias(f"u{i}") for i, s in enumerate(batch))).collect()[0]
        out |= {s: got[f"u{i}"] for i, s in enumerate(batch)}
    return out


def minimal_keys(tables: dict[str, DataFrame], size: int = 2, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table_name, columns, total, uniques): the column sets of up to ``size`` that tell all rows apart and have no nulls, without supersets of other keys.

    Level by level: a set is tried if none of its subsets is a key and the product of their distinct values can reach the number of rows;
    a sketch of all sets of a level, in one scan, leaves those that are counted exactly. An empty table has no keys.
    """
    spark = next(iter(tables.values())).sparkSession
    found: list[tuple] = []
    for name, df in tables.items():
        names = [c for c, k in field_types(df, (columns or {}).get(name)) if not is_nested(k)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(column(c)).alias(f"c{i}") for i, c in enumerate(names))).collect()[0]
        total, names = row["n"], [c for i, c in enumerate(names) if row[f"c{i}"] == row["n"]]
        if not total:
            continue
        slack, estimates, keys = 1 + SIGMAS * ERROR, {}, []
        for level in range(1, size + 1):
            tried = [s for s in combinations(names, level) if not any(set(k) <= set(s) for k in keys)]
            if level > 1:
                tried = [s for s in tried if reduce(lambda x, c: x * estimates[(c,)] * slack, s, 1.0) >= total]
            estimates |= _counts(df, tried, False)
            likely = [s for s in tried if estimates[s] * slack >= total]
            exact = _counts(df, likely, True)
            keys += [s for s in likely if exact[s] == total]
            found += [(name, list(s), total, exact[s]) for s in likely if exact[s] == total]
    return spark.createDataFrame(found, KEYS)


def _class_of(kind: T.DataType) -> str | None:
    """Columns whose values are compared: whole numbers with whole numbers, texts with texts. Measures and times are no references."""
    return "number" if isinstance(kind, T.IntegralType) else "text" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else None


class _Column:
    def __init__(self, table: str, name: str, kind: str, ident: int):
        self.table, self.name, self.kind, self.ident = table, name, kind, ident
        self.total = self.present = self.distinct = 0
        self.low = self.high = None

    def share(self) -> float:
        """The part of all hashes that the sketch keeps."""
        return min(1.0, HASHES / max(1, self.distinct))


def _column_facts(tables: dict[str, DataFrame]) -> list[_Column]:
    out: list[_Column] = []
    for name, df in tables.items():
        mine = [_Column(name, c, _class_of(k), len(out) + i) for i, (c, k) in enumerate((c, k) for c, k in field_types(df) if _class_of(k))]
        for batch in batches(mine):
            aggs = [F.count(F.lit(1)).alias("n")]
            for c in batch:
                x = column(c.name)
                aggs += [F.count(x).alias(f"p{c.ident}"), F.approx_count_distinct(x, ERROR).alias(f"d{c.ident}"), F.min(x).alias(f"l{c.ident}"), F.max(x).alias(f"h{c.ident}")]
            got = df.agg(*aggs).collect()[0]
            for c in batch:
                c.total, c.present, c.distinct, c.low, c.high = got["n"], got[f"p{c.ident}"], got[f"d{c.ident}"], got[f"l{c.ident}"], got[f"h{c.ident}"]
        out += mine
    return out


def _hash(c: Column) -> Column:
    """A value's hash as a number from 0 to 1, the same in any table."""
    return F.xxhash64(c.cast("string")) / F.lit(float(1 << 64)) + 0.5


def _sketches(tables: dict[str, DataFrame], columns: list[_Column]) -> DataFrame:
    """(ident, h): the distinct hashes of each column under its share; about ``HASHES`` of each column leave the scans."""
    parts = []
    for name, df in tables.items():
        mine = [c for c in columns if c.table == name]
        if mine:
            each = F.array(*(F.struct(F.lit(c.ident).alias("ident"), _hash(column(c.name)).alias("h"), F.lit(c.share()).alias("s"), column(c.name).isNotNull().alias("p")) for c in mine))
            parts.append(df.select(F.inline(F.filter(each, lambda x: x["p"] & (x["h"] < x["s"])))).select("ident", "h"))
    return reduce(DataFrame.unionByName, parts).distinct()


def possible_references(tables: dict[str, DataFrame]) -> tuple[list[_Column], list[tuple[int, int]]]:
    """All columns, and the pairs (of column numbers) in which every value of one can be in the other, a key.

    If a column is contained in another one, so is its sketch, as far as both keep hashes: its smallest hash is among the other's, which an equal join of all columns'
    sketches finds, unless it is beyond what the other one keeps; then all others are compared. No contained pair is missed.
    """
    columns = _column_facts(tables)
    keys = {(r["table_name"], r["columns"][0]) for r in minimal_keys(tables, 1, {t: [c.name for c in columns if c.table == t] for t in tables}).collect()}
    parents = [c for c in columns if (c.table, c.name) in keys]
    children = [c for c in columns if (c.table, c.name) not in keys and c.present]
    if not parents or not children:
        return columns, []
    spark = next(iter(tables.values())).sparkSession
    path = scratch_dir(spark, "sketches")
    _sketches(tables, parents + children).write.parquet(path)
    sketches = spark.read.parquet(path)
    schema = "ident int, kind string, share double, low string, high string"
    fact = lambda c: (c.ident, c.kind, c.share(), str(c.low), str(c.high))
    child, parent = spark.createDataFrame(list(map(fact, children)), schema), spark.createDataFrame(list(map(fact, parents)), schema)
    inside = lambda to: (F.col("low").cast(to) >= F.col("p_low").cast(to)) & (F.col("high").cast(to) <= F.col("p_high").cast(to))
    p = parent.select(*[F.col(c).alias(f"p_{c}") for c in parent.columns])
    least = sketches.groupBy("ident").agg(F.min("h").alias("h0")).join(F.broadcast(child), "ident")
    met = least.join(sketches.select(F.col("ident").alias("p_ident"), F.col("h").alias("h0")), "h0").join(F.broadcast(p), "p_ident")
    beyond = F.broadcast(child).join(least.select("ident", "h0"), "ident", "left").join(F.broadcast(p), F.col("kind") == F.col("p_kind")).filter(F.col("h0").isNull() | (F.col("h0") >= F.col("p_share")))
    pairs = met.select("ident", "p_ident", "kind", "p_kind", "low", "high", "p_low", "p_high", "p_share").unionByName(beyond.select("ident", "p_ident", "kind", "p_kind", "low", "high", "p_low", "p_high", "p_share"))
    pairs = pairs.filter((F.col("kind") == F.col("p_kind")) & F.when(F.col("kind") == "number", inside("decimal(38,0)")).otherwise(inside("string")))
    # of the hashes that both would keep, all must be in the other one
    looked = pairs.select("ident", "p_ident", "p_share").join(sketches, "ident", "left").filter(F.col("h").isNull() | (F.col("h") < F.col("p_share")))
    has = sketches.select(F.col("ident").alias("p_ident"), "h", F.lit(1).alias("has"))
    lacking = looked.join(has, ["p_ident", "h"], "left").filter("h is not null and has is null").select("ident", "p_ident").distinct()
    kept = pairs.select("ident", "p_ident").distinct().join(lacking, ["ident", "p_ident"], "left_anti")
    return columns, sorted((r["ident"], r["p_ident"]) for r in kept.collect())


def references_by_value(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns all of whose values are in a key of a table: ``table_name``, ``column_name``, ``foreign_table``, ``foreign_column``, ``missing`` (0), ``used``, ``coverage``.

    ``used`` is how many of the key's values occur, ``coverage`` their share: of several keys that have all values the real one
    mostly has the highest. Keys refer to nothing; nulls are no values. Names play no part.
    """
    spark = next(iter(tables.values())).sparkSession
    columns, pairs = possible_references(tables)
    by = {c.ident: c for c in columns}
    parts = []
    for parent in sorted({p for _, p in pairs}):
        key = by[parent]
        values = [tables[by[c].table].select(F.lit(c).alias("ident"), column(by[c].name).cast("string").alias("v")).filter("v is not null") for c, p in pairs if p == parent]
        values = reduce(DataFrame.unionByName, values).distinct()
        known = tables[key.table].select(column(key.name).cast("string").alias("v"), F.lit(1).alias("has"))
        counts = values.join(known, "v", "left").groupBy("ident").agg((F.count(F.lit(1)) - F.count("has")).alias("missing"), F.count("has").alias("used"))
        named = spark.createDataFrame([(c, by[c].table, by[c].name) for c, p in pairs if p == parent], "ident int, table_name string, column_name string")
        counts = counts.join(F.broadcast(named), "ident").filter("missing = 0")
        parts.append(counts.select("table_name", "column_name", F.lit(key.table).alias("foreign_table"), F.lit(key.name).alias("foreign_column"), "missing", "used", (F.col("used") / key.total).alias("coverage")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], REFERENCES)


def best_references(references: DataFrame) -> DataFrame:
    """The reference of highest coverage of each column; ties go to the first table and column by name."""
    rank = F.row_number().over(W.partitionBy("table_name", "column_name").orderBy(F.desc("coverage"), "foreign_table", "foreign_column"))
    return references.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def join_paths(graph: DataFrame, most: int = 6) -> DataFrame:
    """(table_a, table_b, steps, tables, conditions): the shortest chain of joins between each two tables that have one of up to ``most`` steps.

    ``graph`` is what ``schema.join_graph`` gives. Breadth first, all pairs at once: each round joins the newest paths with the edges and keeps pairs that
    are new. Of equally short chains the first by table names counts.
    """
    edges = graph.filter("table_a <> table_b").select("table_a", "table_b", "condition")
    step = edges.select(F.col("table_a").alias("_at"), F.col("table_b").alias("_to"), "condition")
    first = edges.select("table_a", "table_b", F.lit(1).alias("steps"), F.array("table_a", "table_b").alias("tables"), F.array("condition").alias("conditions"))
    found, newest = first, first
    for _ in range(2, most + 1):
        longer = newest.join(step, newest["table_b"] == step["_at"]).filter("_to <> table_a")
        longer = longer.select("table_a", F.col("_to").alias("table_b"), (F.col("steps") + 1).alias("steps"), F.concat("tables", F.array("_to")).alias("tables"), F.concat("conditions", F.array("condition")).alias("conditions"))
        best = longer.groupBy("table_a", "table_b").agg(F.min(F.struct("steps", "tables", "conditions")).alias("p")).select("table_a", "table_b", "p.*")
        newest = best.join(found.select("table_a", "table_b"), ["table_a", "table_b"], "left_anti")
        found = found.unionByName(newest)
    return found

"""Schema discovery: a catalog of tables and columns, declared and inferred keys, join paths.

The frames have the shape of ``information_schema``: one row per column of a table or
constraint. They are metadata, so they are as many rows as there are columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.types import semantic_type, sql_semantic_type

CATALOG = "table_name string, column_name string, ordinal int, data_type string"


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) of given tables, with upper-case type names."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, i, f.dataType.simpleString().upper()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, CATALOG)


def catalog_of_database(spark: SparkSession, database: str) -> DataFrame:
    """The same of all tables of a database in Spark's own catalog."""
    tables = {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database) if not t.isTemporary}
    return catalog_of(tables) if tables else spark.createDataFrame([], CATALOG)


def catalog_of_information_schema(columns: DataFrame, schema: str = "public") -> DataFrame:
    """The same from rows of ``information_schema.columns`` read over JDBC; system tables are left out."""
    kind = F.upper(F.regexp_replace("data_type", "character varying", "varchar"))
    own = columns.filter((F.col("table_schema") == schema) & not_system("table_name"))
    return own.select("table_name", "column_name", F.col("ordinal_position").cast("int").alias("ordinal"), kind.alias("data_type"))


def not_system(name: str) -> Column:
    return ~F.col(name).ilike("pg\\_%") & ~F.col(name).ilike("sql\\_%")


def with_semantic_types(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("semantic_type", sql_semantic_type(F.col("data_type")))


def primary_keys(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """(table_name, column_name) of the declared primary keys."""
    pk = constraints.filter("constraint_type = 'PRIMARY KEY'").select("constraint_name", "table_schema", "table_name")
    return pk.join(key_usage.select("constraint_name", "table_schema", "column_name"), ["constraint_name", "table_schema"]).select("table_name", "column_name")


def foreign_keys(constraints: DataFrame, key_usage: DataFrame, column_usage: DataFrame) -> DataFrame:
    """(table_name, column_name, foreign_table, foreign_column): all declared foreign keys, several per table too."""
    on = ["constraint_name", "table_schema"]
    fk = constraints.filter("constraint_type = 'FOREIGN KEY'").select(*on, "table_name")
    to = column_usage.select(*on, F.col("table_name").alias("foreign_table"), F.col("column_name").alias("foreign_column"))
    return fk.join(key_usage.select(*on, "column_name"), on).join(to, on).select("table_name", "column_name", "foreign_table", "foreign_column").distinct()


def join_graph(fks: DataFrame) -> DataFrame:
    """(table_a, table_b, condition): both directions of each pair, conditions joined by AND."""
    condition = F.concat("table_name", F.lit("."), "column_name", F.lit("="), "foreign_table", F.lit("."), "foreign_column")
    edges = fks.select(F.col("table_name").alias("table_a"), F.col("foreign_table").alias("table_b"), condition.alias("c"))
    both = edges.unionByName(edges.select(F.col("table_b").alias("table_a"), F.col("table_a").alias("table_b"), "c")).distinct()
    return both.groupBy("table_a", "table_b").agg(F.array_join(F.sort_array(F.collect_list("c")), " AND ").alias("condition"))


def simple_name(column: Column, table: Column | None = None) -> Column:
    """A name without a final s, underscores and case; with its table's in front, if given."""
    short = lambda c: F.regexp_replace(c, "s$", "")
    name = short(column) if table is None else F.concat(short(table), short(column))
    return F.regexp_replace(F.lower(name), "_", "")


def inferred_foreign_keys(catalog: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Columns named like another table and its column, e.g. orders.user_id for users.id, without the declared ones."""
    targets = catalog.select(F.col("table_name").alias("foreign_table"), F.col("column_name").alias("foreign_column"), simple_name(F.col("column_name"), F.col("table_name")).alias("k"))
    named = catalog.select("table_name", "column_name", simple_name(F.col("column_name")).alias("k"))
    found = named.join(targets, "k").select("table_name", "column_name", "foreign_table", "foreign_column")
    return found if declared is None else found.join(declared, ["table_name", "column_name", "foreign_table", "foreign_column"], "left_anti")


def annotated_catalog(catalog: DataFrame, pks: DataFrame, fks: DataFrame) -> DataFrame:
    """The catalog with ``is_pk`` and an array of foreign keys for each column."""
    keys = pks.select("table_name", "column_name", F.lit(True).alias("is_pk")).distinct()
    links = fks.groupBy("table_name", "column_name").agg(F.sort_array(F.collect_set(F.struct("foreign_table", "foreign_column"))).alias("foreign_keys"))
    on = ["table_name", "column_name"]
    none = F.array().cast("array<struct<foreign_table:string,foreign_column:string>>")
    full = catalog.join(keys, on, "left").join(links, on, "left")
    return full.withColumns({"is_pk": F.coalesce("is_pk", F.lit(False)), "foreign_keys": F.coalesce("foreign_keys", none)})


def quoted(name: str) -> Column:
    """The name, in double quotes if it has anything but ASCII letters, digits and underscores."""
    c = F.col(name)
    return F.when(c.rlike("[^A-Za-z0-9_]"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def discovered_keys(tables: dict[str, DataFrame], candidates: dict[str, list[str]]) -> DataFrame:
    """(table_name, column_name, total, uniques, is_key): which candidate columns tell all rows apart, from the data."""
    parts = []
    for name, df in tables.items():
        cols = candidates.get(name, [])
        if not cols:
            continue
        wide = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_distinct(c).alias(f"u{i}") for i, c in enumerate(cols)))
        rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").alias("uniques")) for i, c in enumerate(cols)))
        parts.append(wide.select(F.lit(name).alias("table_name"), "total", F.inline(rows)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("table_name", "column_name", "total", "uniques", (F.col("total") == F.col("uniques")).alias("is_key"))


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(missing): how many distinct values of a column its parent lacks; 0 supports a foreign key."""
    values = child.select(F.col(column).alias("_v")).filter("_v is not null").distinct()
    return values.join(parent.select(F.col(key).alias("_v")), "_v", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


def semantic_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, semantic_type(f.dataType)) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, semantic_type string")

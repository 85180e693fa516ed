"""Schema discovery over the standard tables: keys and references are established from their rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import schema as S
from plumbline.plans.registry import query
from plumbline.session import table

#: Columns tried as keys, by table, and the references tried.
CANDIDATES = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"],
}
REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"),
]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in CANDIDATES}


def key_constraints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of table_constraints and key_column_usage for the columns that are keys by their values."""
    keys = S.discovered_keys(tables(spark, sf_dir), CANDIDATES).filter("is_key")
    name = F.concat_ws("_", F.lit("pk"), "table_name", "column_name").alias("constraint_name")
    made = keys.select(name, F.lit("public").alias("table_schema"), "table_name", F.lit("PRIMARY KEY").alias("constraint_type"), "column_name")
    return made.drop("column_name"), made.drop("constraint_type")


def reference_constraints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the three catalog tables for the references that hold for all values."""
    t = tables(spark, sf_dir)
    parts = [
        S.inclusion(t[a], c, t[b], k).select("missing", F.lit(f"fk_{a}_{c}").alias("constraint_name"), F.lit(a).alias("table_name"), F.lit(c).alias("column_name"), F.lit(b).alias("f_table"), F.lit(k).alias("f_column"))
        for a, c, b, k in REFERENCES
    ]
    held = reduce(DataFrame.unionByName, parts).filter("missing = 0").withColumn("table_schema", F.lit("public"))
    constraints = held.select("constraint_name", "table_schema", "table_name", F.lit("FOREIGN KEY").alias("constraint_type"))
    usage = held.select("constraint_name", "table_schema", "table_name", "column_name")
    return constraints, usage, held.select("constraint_name", "table_schema", F.col("f_table").alias("table_name"), F.col("f_column").alias("column_name"))


_SQL_KEYS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS uniques, count(*) = count(DISTINCT {c}) AS is_key FROM {t}" for t, cs in CANDIDATES.items() for c in cs
)
_SQL_FKS = (
    "SELECT table_name, column_name, foreign_table, foreign_column FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS table_name, '{c}' AS column_name, '{b}' AS foreign_table, '{k}' AS foreign_column, count(*) AS missing FROM (SELECT DISTINCT {c} AS v FROM {a} WHERE {c} IS NOT NULL) WHERE v NOT IN (SELECT {k} FROM {b})"
        for a, c, b, k in REFERENCES
    )
    + ") WHERE missing = 0"
)
_SQL_CATALOG = (
    "SELECT table_name, column_name, (row_number() OVER (PARTITION BY table_name ORDER BY column_index) - 1)::INT AS ordinal,"
    " CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE data_type END AS data_type"
    f" FROM duckdb_columns() WHERE schema_name = 'main' AND table_name IN ({', '.join(repr(t) for t in CANDIDATES)})"
)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.catalog_of(tables(spark, sf_dir))


@query("key_discovery", _SQL_KEYS)
def key_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.discovered_keys(tables(spark, sf_dir), CANDIDATES)


@query("primary_keys", f"SELECT table_name, column_name FROM ({_SQL_KEYS}) WHERE is_key")
def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.primary_keys(*key_constraints(spark, sf_dir))


@query("foreign_keys", _SQL_FKS)
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.foreign_keys(*reference_constraints(spark, sf_dir))


@query(
    "join_graph",
    f"""WITH e AS (SELECT table_name AS a, foreign_table AS b, table_name || '.' || column_name || '=' || foreign_table || '.' || foreign_column AS c FROM ({_SQL_FKS}))
SELECT a AS table_a, b AS table_b, string_agg(c, ' AND ' ORDER BY c) AS condition FROM (SELECT a, b, c FROM e UNION SELECT b, a, c FROM e) GROUP BY a, b""",
)
def join_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.join_graph(S.foreign_keys(*reference_constraints(spark, sf_dir)))


@query("schema_catalog", f"WITH c AS ({_SQL_CATALOG}) SELECT c.*, coalesce(k.uniques, 0) AS uniques FROM c LEFT JOIN ({_SQL_KEYS}) k USING (table_name, column_name)")
def schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns, with the number of different values of those tried as keys."""
    keys = S.discovered_keys(tables(spark, sf_dir), CANDIDATES).select("table_name", "column_name", "uniques")
    return _catalog(spark, sf_dir).join(keys, ["table_name", "column_name"], "left").fillna(0, ["uniques"])


@query(
    "annotated_catalog",
    f"""WITH c AS ({_SQL_CATALOG}), k AS ({_SQL_KEYS}), f AS (SELECT table_name, column_name, string_agg(foreign_table || '.' || foreign_column, ',') AS refs FROM ({_SQL_FKS}) GROUP BY ALL)
SELECT c.table_name, c.column_name, c.data_type, coalesce(k.is_key, false) AS is_pk, coalesce(f.refs, '') AS foreign_keys,
       CASE WHEN data_type IN ('INT', 'BIGINT') THEN 'sc:Integer' WHEN data_type = 'DOUBLE' THEN 'sc:Float' WHEN data_type = 'TIMESTAMP_NTZ' THEN 'sc:Date' ELSE 'sc:Text' END AS semantic_type
FROM c LEFT JOIN k USING (table_name, column_name) LEFT JOIN f USING (table_name, column_name)""",
)
def annotated_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = S.annotated_catalog(_catalog(spark, sf_dir), S.primary_keys(*key_constraints(spark, sf_dir)), S.foreign_keys(*reference_constraints(spark, sf_dir)))
    refs = F.array_join(F.transform("foreign_keys", lambda k: F.concat_ws(".", k["foreign_table"], k["foreign_column"])), ",")
    return S.with_semantic_types(full).select("table_name", "column_name", "data_type", "is_pk", refs.alias("foreign_keys"), "semantic_type")


_SHORT = "regexp_replace({0}, 's$', '')"


@query(
    "inferred_foreign_keys",
    f"""WITH c AS (SELECT table_name, source || '_' || column_name AS column_name FROM (SELECT DISTINCT 'lineitem' AS table_name, 'user' AS source, 'id' AS column_name, event_type FROM events)
               UNION SELECT 'users', 'id' UNION SELECT event_type || 's', 'id' FROM events UNION SELECT 'log', event_type || '_id' FROM events),
s AS (SELECT table_name, column_name, replace(lower({_SHORT.format('column_name')}), '_', '') AS k FROM c),
t AS (SELECT table_name AS foreign_table, column_name AS foreign_column, replace(lower({_SHORT.format('table_name')} || {_SHORT.format('column_name')}), '_', '') AS k FROM c)
SELECT table_name, column_name, foreign_table, foreign_column FROM s JOIN t USING (k) WHERE NOT (table_name = 'lineitem' AND foreign_table = 'users')""",
)
def inferred_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a catalog derived from the events: a table per event type and a log that refers to them."""
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    row = lambda t, c: e.select(t.alias("table_name"), c.alias("column_name"))
    kind = F.col("event_type")
    catalog = row(F.lit("lineitem"), F.lit("user_id")).unionByName(row(F.lit("users"), F.lit("id"))).unionByName(row(F.concat(kind, F.lit("s")), F.lit("id"))).unionByName(row(F.lit("log"), F.concat(kind, F.lit("_id")))).distinct()
    declared = row(F.lit("lineitem"), F.lit("user_id")).distinct().withColumns({"foreign_table": F.lit("users"), "foreign_column": F.lit("id")})
    return S.inferred_foreign_keys(catalog, declared)


@query(
    "quoted_identifiers",
    """SELECT name, CASE WHEN regexp_matches(name, '[^A-Za-z0-9_]') THEN '"' || name || '"' ELSE name END AS quoted
FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT event_type FROM events)
WHERE name NOT ILIKE 'pg\\_%' ESCAPE '\\' AND name NOT ILIKE 'sql\\_%' ESCAPE '\\'""",
)
def quoted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, events = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    names = part.select(F.col("p_type").alias("name")).union(part.select("p_brand")).union(events.select("event_type")).distinct()
    return names.filter(S.not_system("name")).select("name", S.quoted("name").alias("quoted"))

"""Keys, references and join paths of the standard tables, found from their values alone."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import discovery as D
from plumbline.operators import schema as S
from plumbline.plans.registry import query
from plumbline.plans.schema_queries import _SQL_FKS, reference_constraints, tables

NUMBERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
}
TEXTS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
}
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _sql_uniques() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n, count({c}) AS present, count(DISTINCT {c}) AS u FROM {t}" for kind in (NUMBERS, TEXTS) for t, cs in kind.items() for c in cs)


def _sql_inclusions() -> str:
    pairs = [(a, c, b, k) for kind in (NUMBERS, TEXTS) for a, cs in kind.items() for c in cs for b, ks in kind.items() for k in ks if (a, c) != (b, k)]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS table_name, '{c}' AS column_name, '{b}' AS foreign_table, '{k}' AS foreign_column, count(*) FILTER (v NOT IN (SELECT {k} FROM {b} WHERE {k} IS NOT NULL)) AS missing, count(*) AS used FROM (SELECT DISTINCT {c} AS v FROM {a} WHERE {c} IS NOT NULL)"
        for a, c, b, k in pairs
    )


_SQL_REFERENCES = f"""WITH q AS ({_sql_uniques()}), i AS ({_sql_inclusions()}),
found AS (SELECT i.*, used / p.n AS coverage FROM i JOIN q p ON p.t = foreign_table AND p.c = foreign_column AND p.n = p.u AND p.n > 0
          JOIN q k ON k.t = table_name AND k.c = column_name AND k.n <> k.u AND k.present > 0 WHERE missing = 0)
SELECT table_name, column_name, foreign_table, foreign_column, used, coverage::FLOAT::DOUBLE AS coverage,
       row_number() OVER (PARTITION BY table_name, column_name ORDER BY coverage DESC, foreign_table, foreign_column) = 1 AS is_best FROM found"""


@query("references_by_value", _SQL_REFERENCES)
def references_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole-number and text columns of eight tables against all keys, without names or candidates."""
    path = D.scratch_dir(spark, "references")
    D.references_by_value(tables(spark, sf_dir)).write.parquet(path)
    found = spark.read.parquet(path)
    best = D.best_references(found).select("table_name", "column_name", "foreign_table", "foreign_column", F.lit(True).alias("is_best"))
    marked = found.join(best, ["table_name", "column_name", "foreign_table", "foreign_column"], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))
    return marked.select("table_name", "column_name", "foreign_table", "foreign_column", "used", F.col("coverage").cast("float").cast("double").alias("coverage"), "is_best")


def _sql_keys() -> str:
    sets = [s for m in (1, 2) for s in combinations(LINEITEM, m)]
    one = " UNION ALL ".join(f"SELECT '{','.join(s)}' AS columns, count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM lineitem)) AS uniques FROM lineitem" for s in sets)
    return f"""WITH k AS ({one}), y AS (SELECT * FROM k WHERE total = uniques AND total > 0)
SELECT columns, total, uniques FROM y WHERE NOT EXISTS (SELECT 1 FROM y s WHERE s.columns <> y.columns AND list_has_all(string_split(y.columns, ','), string_split(s.columns, ',')))"""


@query("composite_keys", _sql_keys())
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column sets of one or two of all columns of lineitem that tell its rows apart."""
    keys = D.minimal_keys({"lineitem": tables(spark, sf_dir)["lineitem"]}, 2)
    return keys.select(F.array_join("columns", ",").alias("columns"), "total", "uniques")


@query(
    "join_paths",
    f"""WITH RECURSIVE f AS ({_SQL_FKS}), c AS (SELECT table_name AS a, foreign_table AS b, table_name || '.' || column_name || '=' || foreign_table || '.' || foreign_column AS x FROM f),
g AS (SELECT a, b, string_agg(x, ' AND ' ORDER BY x) AS x FROM (SELECT a, b, x FROM c UNION SELECT b, a, x FROM c) GROUP BY a, b),
p(a, b, steps, tables, conditions) AS (
    SELECT a, b, 1, [a, b], [x] FROM g WHERE a <> b
    UNION ALL
    SELECT p.a, g.b, steps + 1, list_append(tables, g.b), list_append(conditions, g.x) FROM p JOIN g ON g.a = p.b WHERE steps < 6 AND NOT list_contains(tables, g.b))
SELECT a AS table_a, b AS table_b, steps, array_to_string(tables, ' - ') AS tables, array_to_string(conditions, ' / ') AS conditions FROM p
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY steps, tables) = 1""",
)
def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest chains of joins between the tables, along the references that hold."""
    graph = S.join_graph(S.foreign_keys(*reference_constraints(spark, sf_dir)))
    path = D.scratch_dir(spark, "graph")
    graph.write.parquet(path)
    return D.join_paths(spark.read.parquet(path)).withColumns({"tables": F.array_join("tables", " - "), "conditions": F.array_join("conditions", " / ")})

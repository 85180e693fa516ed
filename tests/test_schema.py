import pytest
from pyspark.sql import functions as F

from plumbline.operators import schema as S


@pytest.fixture(scope="module")
def catalog_rows(spark):
    s = "public"
    constraints = spark.createDataFrame(
        [("pk_u", s, "users", "PRIMARY KEY"), ("pk_l", s, "lines", "PRIMARY KEY"), ("fk1", s, "orders", "FOREIGN KEY"), ("fk2", s, "orders", "FOREIGN KEY"), ("fk3", s, "users", "FOREIGN KEY"), ("pk_u", "other", "users", "PRIMARY KEY")],
        "constraint_name string, table_schema string, table_name string, constraint_type string",
    )
    usage = spark.createDataFrame(
        [("pk_u", s, "users", "id"), ("pk_l", s, "lines", "order_id"), ("pk_l", s, "lines", "line_no"), ("fk1", s, "orders", "user_id"), ("fk2", s, "orders", "payer_id"), ("fk3", s, "users", "boss_id")],
        "constraint_name string, table_schema string, table_name string, column_name string",
    )
    target = spark.createDataFrame([("fk1", s, "users", "id"), ("fk2", s, "users", "id"), ("fk3", s, "users", "id")], "constraint_name string, table_schema string, table_name string, column_name string")
    return constraints, usage, target


def test_primary_keys_may_be_composite(catalog_rows):
    got = {tuple(r) for r in S.primary_keys(*catalog_rows[:2]).collect()}
    assert got == {("users", "id"), ("lines", "order_id"), ("lines", "line_no")}


def test_all_foreign_keys_of_a_table_are_kept(catalog_rows):
    got = {tuple(r) for r in S.foreign_keys(*catalog_rows).collect()}
    assert got == {("orders", "user_id", "users", "id"), ("orders", "payer_id", "users", "id"), ("users", "boss_id", "users", "id")}


def test_join_graph_is_symmetric_and_distinct(catalog_rows):
    got = {(r["table_a"], r["table_b"]): r["condition"] for r in S.join_graph(S.foreign_keys(*catalog_rows)).collect()}
    assert got[("orders", "users")] == got[("users", "orders")] == "orders.payer_id=users.id AND orders.user_id=users.id"
    assert got[("users", "users")] == "users.boss_id=users.id"


def test_annotation(spark, catalog_rows):
    catalog = spark.createDataFrame([("users", "id", 0, "INT"), ("orders", "user_id", 0, "INT"), ("orders", "total", 1, "DOUBLE")], S.CATALOG)
    got = {(r["table_name"], r["column_name"]): r for r in S.annotated_catalog(catalog, S.primary_keys(*catalog_rows[:2]), S.foreign_keys(*catalog_rows)).collect()}
    assert got[("users", "id")]["is_pk"] and not got[("orders", "total")]["is_pk"] and got[("orders", "total")]["foreign_keys"] == []
    assert [tuple(k) for k in got[("orders", "user_id")]["foreign_keys"]] == [("users", "id")]


def test_keys_are_inferred_from_names(spark):
    catalog = spark.createDataFrame([(t, c, 0, "INT") for t, c in [("users", "id"), ("users", "name"), ("orders", "id"), ("orders", "user_id"), ("orders", "total")]], S.CATALOG)
    assert [tuple(r) for r in S.inferred_foreign_keys(catalog).collect()] == [("orders", "user_id", "users", "id")]
    declared = spark.createDataFrame([("orders", "user_id", "users", "id")], "table_name string, column_name string, foreign_table string, foreign_column string")
    assert S.inferred_foreign_keys(catalog, declared).isEmpty()


def test_names_are_quoted_and_system_tables_left_out(spark):
    df = spark.createDataFrame([("plain_1",), ("has space",), ("é",), ("pg_class",), ("SQL_x",), ("pgx",)], "n string")
    assert [r[0] for r in df.filter(S.not_system("n")).select(S.quoted("n")).collect()] == ["plain_1", '"has space"', '"é"', "pgx"]


def test_information_schema(spark):
    cols = spark.createDataFrame([("public", "t", "a", 1, "character varying"), ("public", "pg_stat", "b", 1, "integer"), ("x", "t", "c", 1, "integer")], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")
    got = S.with_semantic_types(S.catalog_of_information_schema(cols)).collect()
    assert [tuple(r) for r in got] == [("t", "a", 1, "VARCHAR", "sc:Text")]


def test_keys_from_data(spark):
    t = {"a": spark.createDataFrame([(1, 1), (2, 1)], "id int, g int"), "b": spark.createDataFrame([(1,), (3,)], "a_id int")}
    got = {r["column_name"]: r["is_key"] for r in S.discovered_keys(t, {"a": ["id", "g"]}).collect()}
    assert got == {"id": True, "g": False}
    assert S.inclusion(t["b"], "a_id", t["a"], "id").collect()[0]["missing"] == 1


def test_catalog_of_database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).select(F.col("id"), F.lit("x").alias("s")).write.mode("overwrite").saveAsTable("shop.things")
    assert {tuple(r) for r in S.catalog_of_database(spark, "shop").collect()} == {("things", "id", 0, "BIGINT"), ("things", "s", 1, "STRING")}

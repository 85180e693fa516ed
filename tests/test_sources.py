import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import assemble as A
from plumbline.operators import columns as C
from plumbline.operators import inventory as I
from plumbline.sources import files, jdbc, store
from plumbline.streaming import profile as P


def put(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_malformed_csv(spark, tmp_path):
    path = put(tmp_path, "bad.csv", 'id;name;note\n1;"two\nlines";x\n2;too;many;fields\n3;short\n4;NA;caf\xe9\n5;;"q ""in"" q"\n'.encode("latin-1"))
    got = [tuple(r) for r in files.read_csv(spark, path, ";").orderBy("id").collect()]
    assert got == [("1", "two\nlines", "x"), ("3", "short", None), ("4", None, "café"), ("5", None, 'q "in" q')]


def test_empty_csv(spark, tmp_path):
    path = put(tmp_path, "empty.csv", b"")
    assert files.csv_columns(spark, path) == [] and files.read_csv(spark, path).count() == 0


def test_delimiters(spark, tmp_path):
    want = {"a.csv": ",", "b.csv": ";", "c.csv": "\t", "d.csv": "|", "one.csv": ","}
    for name, d in want.items():
        put(tmp_path, f"d/{name}", b"a\nb\nc\n" if name == "one.csv" else "\n".join(d.join(["x", f"y{i}", "z z"]) for i in range(200)).encode())
    got = {r["path"].rsplit("/", 1)[1]: r["delimiter"] for r in files.detect_delimiters(spark, str(tmp_path / "d")).collect()}
    assert got == want


def test_encodings(spark, tmp_path):
    put(tmp_path, "t/a.txt", "é".encode())
    put(tmp_path, "t/b.txt", "é".encode("latin-1"))
    assert {(r["text"], r["encoding"], r["size_bytes"]) for r in files.read_texts(spark, str(tmp_path / "t")).collect()} == {("é", "utf-8", 2), ("é", "iso-8859-1", 1)}


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.csv": b"x", "b.CSV": b"xy", "c.xyz": b"1", "sub/d.txt": b"hello", "sub/e.bin": b"123", "mixed/z.pdf": b"1", "mixed/y.txt": b"12", "none/q.bin": b"1", "README": b"r"}.items():
        put(tmp_path, f"root/{name}", data)
    return str(tmp_path / "root")


def test_inventory(spark, folder):
    listing = files.list_files(spark, folder)
    d = {r["name"]: r for r in I.distributions(listing, folder).collect()}
    assert set(d) == {"a.csv", "b.CSV", "d.txt", "e.bin", "z.pdf", "y.txt", "q.bin", "sub", "mixed"}
    assert d["b.CSV"]["encoding_format"] == "text/csv" and d["b.CSV"]["profiler_kind"] == "table" and d["b.CSV"]["kind"] == "file"
    assert d["e.bin"]["is_minimal"] and d["e.bin"]["contained_in"] == d["sub"]["id"] and d["sub"]["content_size"] == "8 B"
    assert d["mixed"]["encoding_format"] == "text/plain" and d["mixed"]["includes"] == "mixed/*"
    assert {r["path"].rsplit("/", 1)[1] for r in I.unsupported_files(listing).collect()} == {"c.xyz", "e.bin", "q.bin", "README"}
    assert {r["kind"]: r["n"] for r in I.counts_by_kind(I.distributions(listing, folder)).collect()} == {"file": 2, "file_in_set": 5, "file_set": 2}
    again = {r["name"]: r["id"] for r in I.distributions(listing, folder).collect()}
    assert all(d[n]["id"] == i for n, i in again.items())


def test_digests(spark, folder):
    dists = I.with_digests(I.distributions(files.list_files(spark, folder), folder), files.digests(spark, folder))
    got = {r["name"]: r["content_sha256"] for r in dists.collect()}
    assert got["a.csv"] == hashlib.sha256(b"x").hexdigest() and got["d.txt"] == hashlib.sha256(b"hello").hexdigest() and got["sub"] is None


def test_listing_does_not_read_contents(spark, folder):
    plan = files.list_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_profiles(spark, folder):
    dists = I.distributions(files.list_files(spark, folder), folder).withColumn("dataset_id", F.lit("ds"))
    top = A.top_level(spark.createDataFrame([("ds", "Name", ["k"])], "id string, name string, keywords array<string>"), "/r/")
    table = dists.filter("name = 'a.csv'").select(F.col("id").alias("distribution_id")).collect()[0][0]
    prof = C.profile_tables({"a": spark.range(4)}).withColumns({"dataset_id": F.lit("ds"), "distribution_id": F.lit(table)})
    sets = A.column_fields(prof)
    light = A.light_profile(top, dists).collect()[0]
    assert len(light["distribution"]) == 7 and light["dataset"]["archivedAt"] == "/r/ds" and light["dataset"]["status"] == "loaded"
    heavy = A.heavy_profile(A.light_profile(top, dists), sets)
    assert heavy.collect()[0]["recordSet"][0]["fields"][0]["statistics"]["row_count"] == 4
    flat = {f["name"]: f for f in A.flat_profile(top, dists, sets).collect()[0]["files"]}
    assert flat["a.csv"]["tables"][0]["record_set"] == "a" and flat["b.CSV"]["tables"] == []
    assert {r["name"] for r in A.without_record_sets(dists, sets).collect()} == {"b.CSV", "d.txt", "e.bin", "z.pdf", "y.txt", "q.bin"}
    assert [r["name"] for r in A.matched(dists, sets).collect()] == ["a.csv"]
    assert json.loads(A.as_json(heavy).collect()[0]["json"])["dataset"]["name"] == "Name"
    assert json.loads(A.context_json("http://example.org/ext/"))["dg"] == "http://example.org/ext/"
    assert json.loads(A.as_json(heavy, "http://example.org/ext/").collect()[0]["json"])["@context"]["recordSet"] == "cr:recordSet"


def test_fields_samples_examples_and_sheets(spark):
    df = spark.createDataFrame([(i, f'v"{i}') for i in range(40)], "k bigint, v string")
    prof = C.profile_tables({"t": df}).withColumns({"dataset_id": F.lit("ds"), "distribution_id": F.lit("f1")})
    sets = A.with_examples(A.column_fields(prof, C.value_sample(df, F.xxhash64("k"))), C.table_examples(df, "k")).collect()[0]
    assert [f["name"] for f in sets["fields"]] == ["k", "v"] and all(len(f["sample"]) == 10 for f in sets["fields"])
    assert sets["fields"][1]["source"]["extract"]["column"] == "v" and sets["fields"][0]["source"]["fileObject"] == "f1"
    assert json.loads(sets["examples"])["v"][3] == 'v"3' and len(json.loads(sets["examples"])["k"]) == 30
    books = spark.createDataFrame([("b1", "ds", "xlsx")], "id string, dataset_id string, encoding_format string")
    sheets = spark.createDataFrame([("b1", "one"), ("b1", "one"), ("b1", "two"), ("b9", "x")], "distribution_id string, sheet_name string")
    assert {(r["name"], r["contained_in"], r["dataset_id"]) for r in A.sheet_distributions(books, sheets).collect()} == {("one", "b1", "ds"), ("two", "b1", "ds")}


def test_databases(spark):
    conn = spark.createDataFrame([("postgresql", "h", 1, "db")], "protocol string, host string, port int, database_name string")
    names = spark.createDataFrame([("db", "t1"), ("db", "t2")], "database_name string, table_name string")
    d = I.database_distributions(conn, names)
    rows = {r["name"]: r for r in d.collect()}
    assert rows["db"]["content_url"] == "postgresql://h:1/db" and rows["t1"]["contained_in"] == rows["db"]["id"]
    got = {r["table_name"]: r["distribution_id"] for r in A.database_record_sets(spark.createDataFrame([("t1",), ("t9",)], "table_name string"), d).collect()}
    assert got == {"t1": rows["t1"]["id"], "t9": None}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    df = lambda *rows: spark.createDataFrame(rows, "dataset_id string, json string")
    store.put(df(("a", "1"), ("b", "2")), path)
    store.put(df(("a", "3")), path)
    assert {r["json"] for r in store.get(spark, path, "a").collect()} == {"3"} and {r["json"] for r in store.get(spark, path, "b").collect()} == {"2"}
    assert "PartitionFilters: [isnotnull(dataset_id" in store.get(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    store.write_json(df(("a", '{"x":1}')), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).collect()[0]["value"] == '{"x":1}'


def test_compaction(spark, tmp_path):
    for name, data, t in (("1.json", '{"@id": "a", "v": 1}', 100), ("2.json", '{"@id": "a",\n "v": 2}', 200), ("3.json", '{"v": 3}', 300), ("4.json", "{broken", 400), ("5.json", '{"@id": "b"}', 50)):
        os.utime(put(tmp_path, f"p/{name}", data.encode()), (t, t))
    got = {r["dataset_id"]: r["path"].rsplit("/", 1)[1] for r in store.compact(spark, str(tmp_path / "p")).collect()}
    assert got == {"a": "2.json", "b": "5.json"}


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("twice")).write.format("jdbc").option("url", url).option("dbtable", "things").options(**props).save()
    got = jdbc.read_table(spark, url, "things", props, '"id"', (0, 100), 4)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("twice")).collect()[0][0] == 9900
    with pytest.raises(Exception, match="(?i)missing|not exist"):
        jdbc.read_table(spark, url, "missing", props).count()


def test_states_merge_to_the_whole(spark):
    df = spark.range(1000).select((F.col("id") + 1e9).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("y"), (F.col("id") % 7).alias("g"))
    parts = P.partial_state(df.filter("g < 3")).unionByName(P.partial_state(df.filter("g >= 3")))
    got = {r["column_name"]: r for r in P.profile_of_state(P.merge_states(parts)).collect()}
    want = {r["column_name"]: r for r in C.profile_columns(df).collect()}
    for c in ("x", "y"):
        for k in ("row_count", "missing_count", "mean", "variance", "min_value", "max_value"):
            assert got[c][k] == pytest.approx(want[c][k], rel=1e-9), (c, k)
        assert got[c]["approx_unique_count"] == pytest.approx(want[c]["unique_count"], rel=0.05)


def test_running_profile_counts_a_batch_once(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(src)
        P.running_profile(stream, "t", state, str(tmp_path / "ck")).awaitTermination()
    P.put_batch(spark.range(10, 20), 1, "t", state)  # a batch delivered again
    r = P.current_profile(spark, state, "t").collect()[0]
    assert (r["row_count"], r["mean"], r["min_value"], r["max_value"]) == (30, 14.5, 0.0, 29.0)
    compacted = str(tmp_path / "compacted")
    P.compact_state(spark, state, compacted)
    assert {r["batch_id"] for r in spark.read.parquet(compacted).collect()} == {-1, 2}
    P.put_batch(spark.range(20, 30), 2, "t", compacted)  # the last one delivered again
    again = P.current_profile(spark, compacted, "t").collect()[0]
    assert (again["row_count"], again["mean"], again["variance"]) == (30, 14.5, pytest.approx(r["variance"]))


def test_database_tables_hold_columns_values_and_examples(spark):
    users = spark.createDataFrame([(i, f"n{i % 4}", None if i % 3 else i / 2) for i in range(50)], "id int, name string, score double")
    logs = spark.createDataFrame([(i, i % 5) for i in range(7)], "log_id bigint, user_id int")
    names = spark.createDataFrame([("shop", "users")], "database_name string, table_name string")
    connection = names.select(F.lit("postgresql").alias("protocol"), F.lit("h").alias("host"), F.lit(1).alias("port"), "database_name")
    dists = I.database_distributions(connection, names)
    sets = {r["table_name"]: r for r in A.database_tables({"users": users, "logs": logs}, {"users": "id", "logs": "log_id"}, dists, "d", rows=5).collect()}
    assert [(f["name"], f["data_type"], f["statistics"]["row_count"], f["sample"]) for f in sets["users"]["fields"]] == [
        ("id", "sc:Integer", 50, ["0", "1", "2"]), ("name", "sc:Text", 50, ["n0", "n1", "n2"]), ("score", "sc:Float", 17, ["0.0", "1.5", "3.0"])
    ]
    assert json.loads(sets["users"]["examples"]) == {"id": [0, 1, 2, 3, 4], "name": ["n0", "n1", "n2", "n3", "n0"], "score": [0.0, None, None, 1.5, None]}
    assert sets["logs"]["distribution_id"] is None and sets["users"]["fields"][0]["source"]["fileObject"] == sets["users"]["distribution_id"]
    flat = A.flat_databases(A.database_tables({"users": users, "logs": logs}, {"users": "id", "logs": "log_id"}, dists, "d"), dists).collect()
    assert len(flat) == 1 and [t["name"] for t in flat[0]["tables"]] == ["users"]
    assert [c["primitive_type"] for c in flat[0]["tables"][0]["columns"]] == ["sc:Integer", "sc:Text", "sc:Float"]


def test_database_tables_count_many_distinct_values_exactly(spark):
    n = C.UNIQUE_FLAG + 30_000
    dists = spark.createDataFrame([], "kind string, id string, name string")
    f = A.database_tables({"t": spark.range(n).selectExpr("id", "id % 7 AS few")}, {"t": "id"}, dists, "d").select(F.inline("fields")).collect()
    assert [(r["name"], r["statistics"]["unique_count"], r["statistics"]["unique_is_estimate"]) for r in f] == [("id", n, False), ("few", 7, False)]


def tasks_of(spark, run):
    """The numbers of tasks of the stages that ``run`` has."""
    spark.sparkContext.setJobGroup("counted", run.__name__)
    try:
        run()
        tracker = spark.sparkContext.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup("counted") for i in tracker.getJobInfo(j).stageIds}
        return [tracker.getStageInfo(i).numTasks for i in stages]
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(90):
        put(tmp_path, f"d/k={k}/a.csv", b"x")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    at, most = str(tmp_path / "d"), 4 * spark.sparkContext.defaultParallelism
    for load in (files.list_files, files.read_texts):
        found = tasks_of(spark, lambda load=load: load(spark, at))
        assert found and max(found) <= most < 90 and load(spark, at).count() == 90
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == before


def test_profiles_to_compact_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(90):
        os.utime(put(tmp_path, f"p/{k % 2}/k={k}/a.json", f'{{"@id": "d{k % 30}"}}'.encode()), (k, k))
    found = tasks_of(spark, lambda: store.compact(spark, str(tmp_path / "p"), recursive=True))
    assert found and max(found) <= 4 * spark.sparkContext.defaultParallelism < 45
    got = {r["dataset_id"]: r["path"].rsplit("/", 2)[1] for r in store.compact(spark, str(tmp_path / "p"), recursive=True).collect()}
    assert got == {f"d{k % 30}": f"k={k}" for k in range(60, 90)}


def test_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).coalesce(1).selectExpr("concat('n=', id % 3, '/k=', id, '/t.txt') AS path", "CAST(concat('text é ', id) AS binary) AS content")
    at = f"file://{tmp_path}/w"
    assert max(tasks_of(spark, lambda: files.write_files(rows, at))) > 1
    files.write_files(rows, at)  # again, as a task may be
    got = files.read_texts(spark, at).collect()
    assert {r["path"].removeprefix(f"{tmp_path}/w/"): r["text"] for r in got} == {f"n={k % 3}/k={k}/t.txt": f"text é {k}" for k in range(40)} and len(got) == 40
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "w")) == 40

"""Inventories and assembled profiles: documents stand for the files of a dataset, their sources for its directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import assemble as A
from plumbline.operators import columns as C
from plumbline.operators import documents as D
from plumbline.operators import inventory as I
from plumbline.plans.registry import query
from plumbline.session import table

ROOT = "/data"
EXTENSIONS = [".csv", ".CSV", ".txt", ".xyz", ".pdf", "", ".xlsx", ".json", ".tar.gz", ".html"]


def kind_of(source: str, lang: str) -> str:
    """SQL for the number of a document's extension, from its source and language."""
    return f"conv(substring(md5(concat_ws('|', {source}, {lang})), 1, 7), 16, 10) % {len(EXTENSIONS)}"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: those of source src0 in the root, the others in a directory of their source; extensions go by source and language."""
    d = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), F.expr(kind_of("source", "lang")).cast("int"))
    folder = F.when(F.col("source") == "src0", F.lit(ROOT)).otherwise(F.concat(F.lit(ROOT + "/"), "source"))
    return d.select(F.concat(folder, F.lit("/doc"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("n_chars").alias("length"), "doc_id", "source")


_NO = f"(('0x' || substr(md5(concat_ws('|', source, lang)), 1, 7))::BIGINT % {len(EXTENSIONS)})"
_EXT = f"CASE {_NO} " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
_SUFFIX = f"CASE {_NO} " + " ".join(f"WHEN {i} THEN '{e.lower().split('.')[-1] and '.' + e.lower().split('.')[-1] if e else ''}'" for i, e in enumerate(EXTENSIONS)) + " END"
_MIME = "CASE suffix " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in I.MEDIA_TYPES.items()) + " END"
_KIND = "CASE suffix " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in I.PROFILERS.items()) + " END"
_FILES = f"""
f AS (SELECT *, {_MIME} AS mime, {_KIND} AS profiler FROM (
  SELECT doc_id, n_chars, source, 'doc' || doc_id || ({_EXT}) AS name, {_SUFFIX} AS suffix,
         CASE WHEN source = 'src0' THEN '{ROOT}' ELSE '{ROOT}/' || source END AS dir FROM documents)),
p AS (SELECT *, dir || '/' || name AS path FROM f),
dist AS (SELECT sha256(path) AS id, CASE WHEN dir = '{ROOT}' THEN 'file' ELSE 'file_in_set' END AS kind, name, n_chars AS size_bytes, n_chars || ' B' AS content_size, path AS content_url,
                mime AS encoding_format, sha256(path) AS path_sha256, CASE WHEN dir <> '{ROOT}' THEN sha256(dir) END AS contained_in, mime IS NULL AS is_minimal, profiler AS profiler_kind
         FROM p WHERE NOT (mime IS NULL AND dir = '{ROOT}')),
sets AS (SELECT dir, sum(n_chars)::BIGINT AS size_bytes, count(*) AS n_files, arg_min(mime, path) FILTER (mime IS NOT NULL) AS mime, arg_min(coalesce(profiler, ''), path) FILTER (mime IS NOT NULL) AS profiler
         FROM p WHERE dir <> '{ROOT}' GROUP BY dir HAVING count(mime) > 0)"""


@query("file_inventory", f"WITH {_FILES} SELECT * FROM dist")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.file_distributions(listing(spark, sf_dir), ROOT)


@query(
    "file_set_sizes",
    f"""WITH {_FILES} SELECT sha256(dir) AS id, split_part(dir, '/', 3) AS name, size_bytes, size_bytes || ' B' AS content_size, dir AS content_url, mime AS encoding_format,
nullif(profiler, '') AS profiler_kind, split_part(dir, '/', 3) || '/*' AS includes, n_files FROM sets""",
)
def file_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.file_sets(listing(spark, sf_dir), ROOT).drop("kind", "is_minimal")


@query("unsupported_files", f"WITH {_FILES} SELECT path, suffix AS extension FROM p WHERE mime IS NULL")
def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unsupported_files(listing(spark, sf_dir))


@query("distribution_counts", f"WITH {_FILES} SELECT kind, count(*) AS n FROM dist GROUP BY kind UNION ALL SELECT 'file_set', count(*) FROM sets")
def distribution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.counts_by_kind(I.distributions(listing(spark, sf_dir), ROOT))


@query(
    "page_url_parts",
    """SELECT page_id, regexp_extract(path, '([^/]+)/*$', 1) AS name, regexp_replace(path, '/[^/]+/*$', '') AS parent FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)""",
)
def page_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", I.file_name(path).alias("name"), I.parent_dir(path).alias("parent"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset specification per source of the documents."""
    d = table(spark, sf_dir, "documents").filter("source is not null")
    return d.groupBy(F.col("source").alias("id")).agg(F.concat(F.lit("Documents of "), F.first("source")).alias("name"), F.sort_array(F.collect_set("lang")).alias("inLanguage"))


def source_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions with the dataset that each belongs to: the name of its directory, src0 for files in the root."""
    dists = I.distributions(listing(spark, sf_dir), ROOT)
    dataset = F.when(F.col("kind") == "file", F.lit("src0")).otherwise(F.regexp_extract("content_url", f"^{ROOT}/([^/]+)", 1))
    return dists.withColumn("dataset_id", dataset)


def document_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sets of all documents: their profiles, with the id of their distribution."""
    texts = table(spark, sf_dir, "documents")
    path = F.col("path")
    files = listing(spark, sf_dir).select("doc_id", F.col("source").alias("dataset_id"), I.stable_id(path).alias("distribution_id"), I.stem(path).alias("record_set"))
    counted = D.document_sizes(texts)
    return counted.join(files, "doc_id").select("dataset_id", "distribution_id", "record_set", "num_words", "num_lines", "num_characters")


_TOP = "top AS (SELECT source AS dataset_id, 'Documents of ' || source AS name, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents WHERE source IS NOT NULL GROUP BY source)"
_ALL = "all_dists AS (SELECT CASE kind WHEN 'file' THEN 'src0' ELSE split_part(content_url, '/', 3) END AS dataset_id, kind, id, content_url FROM dist WHERE NOT is_minimal UNION ALL SELECT split_part(dir, '/', 3), 'file_set', sha256(dir), dir FROM sets)"
_WORDS = "len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))::BIGINT"


@query(
    "light_profile",
    f"""WITH {_FILES}, {_TOP}, {_ALL} SELECT dataset_id, name, languages, count(*) FILTER (kind = 'file_set') AS file_sets, count(*) FILTER (kind <> 'file_set') AS files, min(content_url) AS first_url,
sha256(string_agg(id, ',' ORDER BY kind, id)) AS ids_sha256 FROM top LEFT JOIN all_dists USING (dataset_id) GROUP BY ALL""",
)
def light_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = A.light_profile(A.top_level(datasets(spark, sf_dir), ROOT + "/"), source_distributions(spark, sf_dir))
    of = lambda p: F.coalesce(F.size(F.filter("distribution", p)), F.lit(0)).cast("bigint")
    each = lambda k: F.transform("distribution", lambda d: d[k])
    return light.select(
        "dataset_id", F.col("dataset.name").alias("name"), F.array_join("dataset.inLanguage", ",").alias("languages"), of(lambda d: d["kind"] == "file_set").alias("file_sets"),
        of(lambda d: d["kind"] != "file_set").alias("files"), F.array_min(each("content_url")).alias("first_url"), F.sha2(F.array_join(each("id"), ","), 256).alias("ids_sha256"),
    )


@query(
    "heavy_profile",
    f"""WITH {_FILES}, {_TOP}, {_ALL},
r AS (SELECT source AS dataset_id, count(*) AS record_sets, sum({_WORDS})::BIGINT AS words, sha256(string_agg(sha256(path), ',' ORDER BY sha256(path))) AS sets_sha256 FROM documents JOIN (SELECT doc_id, path FROM p) USING (doc_id) GROUP BY source),
n AS (SELECT dataset_id, count(*) AS distributions FROM all_dists GROUP BY dataset_id)
SELECT dataset_id, coalesce(distributions, 0) AS distributions, coalesce(record_sets, 0) AS record_sets, coalesce(words, 0) AS words, sets_sha256 FROM top LEFT JOIN n USING (dataset_id) LEFT JOIN r USING (dataset_id)""",
)
def heavy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = A.light_profile(A.top_level(datasets(spark, sf_dir)), source_distributions(spark, sf_dir))
    heavy = A.heavy_profile(light, A.record_sets(document_sets(spark, sf_dir)))
    words = F.aggregate("recordSet", F.lit(0).cast("bigint"), lambda a, r: a + r["num_words"])
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    ids = F.array_join(F.transform("recordSet", lambda r: r["distribution_id"]), ",")
    return heavy.select("dataset_id", count("distribution").alias("distributions"), count("recordSet").alias("record_sets"), F.coalesce(words, F.lit(0)).alias("words"), F.sha2(ids, 256).alias("sets_sha256"))


_JSON_DIST = """json_object('kind', kind, 'id', id, 'name', name, 'content_size', content_size, 'content_url', content_url, 'encoding_format', encoding_format, 'sha256', sha, 'contained_in', contained_in, 'includes', includes)"""
_JSON_TOP = (
    "'{\"@context\":' || '"
    + A.context_json("http://example.org/ext/")
    + "' || ',' || substr(json_object("
    + ", ".join(f"'{f}', " + {"id": "source", "name": "'Documents of ' || source"}.get(f, "NULL") for f in A.TEXT_FIELDS)
    + ", 'keywords', [], 'fieldOfScience', [], 'inLanguage', list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)), 'archivedAt', '"
    + ROOT
    + "/' || source, 'access', '', 'status', 'loaded')::VARCHAR, 2)"
)


@query(
    "profile_records",
    f"""WITH {_FILES},
u AS (SELECT CASE kind WHEN 'file' THEN 'src0' ELSE split_part(content_url, '/', 3) END AS dataset_id, kind, id, name, content_size, content_url, encoding_format, path_sha256 AS sha, contained_in, NULL AS includes FROM dist WHERE NOT is_minimal
UNION ALL SELECT split_part(dir, '/', 3), 'file_set', sha256(dir), split_part(dir, '/', 3), size_bytes || ' B', dir, mime, NULL, NULL, split_part(dir, '/', 3) || '/*' FROM sets)
SELECT source AS dataset_id, 'dataset' AS part, source AS id, {_JSON_TOP} AS json FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT dataset_id, 'distribution', id, {_JSON_DIST}::VARCHAR FROM u
UNION ALL SELECT source, 'recordSet', sha256(path), json_object('id', sha256(path), 'name', regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1'), 'words', {_WORDS})::VARCHAR FROM documents JOIN (SELECT doc_id, path FROM p) USING (doc_id)""",
)
def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavy profile as records with their whole JSON, without any row that grows with its dataset."""
    sets = document_sets(spark, sf_dir).select("dataset_id", F.col("distribution_id").alias("id"), F.col("record_set").alias("name"), F.col("num_words").alias("words"))
    return A.profile_records(A.top_level(datasets(spark, sf_dir), ROOT + "/"), source_distributions(spark, sf_dir), sets, "http://example.org/ext/")


@query(
    "flat_profile",
    f"""WITH {_FILES}, n AS (SELECT doc_id, {_WORDS} AS words FROM documents)
SELECT CASE kind WHEN 'file' THEN 'src0' ELSE split_part(content_url, '/', 3) END AS dataset_id, dist.id AS file_object_id, encoding_format, 1::BIGINT AS n_tables, words
FROM dist JOIN p ON p.path = dist.content_url JOIN n USING (doc_id)""",
)
def flat_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = A.flat_profile(A.top_level(datasets(spark, sf_dir)), source_distributions(spark, sf_dir), document_sets(spark, sf_dir))
    f = flat.select("dataset_id", F.explode("files").alias("f"))
    return f.select("dataset_id", "f.file_object_id", "f.encoding_format", F.size("f.tables").cast("bigint").alias("n_tables"), F.col("f.tables")[0]["num_words"].alias("words"))


@query("sheet_distributions", f"WITH {_FILES} SELECT sha256(dist.id || '/' || s) AS id, s AS name, dist.id AS contained_in, encoding_format, false AS is_minimal FROM dist, (SELECT unnest(['first', 'second']) AS s) WHERE profiler_kind = 'workbook'")
def sheet_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record sets of each workbook, each with a distribution of its sheet."""
    books = I.distributions(listing(spark, sf_dir), ROOT).filter("profiler_kind = 'workbook' and kind <> 'file_set'")
    sheets = books.select(F.col("id").alias("distribution_id"), F.explode(F.array(F.lit("first"), F.lit("second"))).alias("sheet_name"))
    return A.sheet_distributions(books, sheets.unionByName(sheets)).drop("kind")


@query(
    "distributions_of_databases",
    f"""WITH {_FILES}, t AS (SELECT DISTINCT event_type FROM events) SELECT kind, count(*) AS n FROM (SELECT kind FROM dist UNION ALL SELECT 'file_set' FROM sets UNION ALL SELECT 'database_table' FROM t UNION ALL SELECT 'database' WHERE EXISTS (FROM t)) GROUP BY kind""",
)
def distributions_of_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, file sets, a database and its tables in one inventory."""
    names = table(spark, sf_dir, "events").select(F.lit("events").alias("database_name"), F.col("event_type").alias("table_name")).distinct()
    connection = names.select(F.lit("postgresql").alias("protocol"), F.lit("db").alias("host"), F.lit(5432).alias("port"), "database_name").distinct()
    return I.counts_by_kind(I.distributions(listing(spark, sf_dir), ROOT, I.database_distributions(connection, names)))


@query(
    "all_record_sets",
    f"""WITH {_FILES} SELECT 'files' AS origin, source AS dataset_id, count(*) AS n, sum({_WORDS})::BIGINT AS words, NULL::BIGINT AS n_fields FROM documents GROUP BY source
UNION ALL SELECT 'database', 'events', count(DISTINCT event_type), NULL, NULL FROM events UNION ALL SELECT 'table', 'sales', 1, NULL, 6 FROM (SELECT count(*) AS n FROM orders) WHERE n > 0""",
)
def all_record_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record sets of a table, of a database's tables and of all documents in one frame; each part keeps its own columns."""
    tables = A.column_fields(C.profile_tables({"orders": table(spark, sf_dir, "orders")}, distinct="approx").withColumns({"dataset_id": F.lit("sales"), "distribution_id": F.lit("orders")}))
    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("record_set")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("dataset_id", F.lit("events"))
    origin = lambda df, name: df.withColumn("origin", F.lit(name))
    union = A.record_sets(origin(tables, "table"), origin(events, "database"), origin(document_sets(spark, sf_dir), "files"))
    return union.groupBy("origin", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("num_words").alias("words"), F.sum(F.size("fields")).alias("n_fields"))


@query("files_without_record_sets", f"WITH {_FILES} SELECT id, content_url FROM dist WHERE content_url NOT LIKE '%.txt'")
def files_without_record_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    dists = I.distributions(listing(spark, sf_dir), ROOT)
    texts = dists.filter(F.col("profiler_kind") == "text").select(F.col("id").alias("distribution_id"))
    return A.without_record_sets(dists, texts).select("id", "content_url")


@query(
    "matched_record_sets",
    f"""WITH {_FILES} SELECT dist.id, 1::BIGINT AS n_record_sets, {_WORDS} AS words FROM documents d JOIN (SELECT doc_id, path FROM p) p USING (doc_id) JOIN dist ON dist.content_url = p.path""",
)
def matched_record_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.matched(source_distributions(spark, sf_dir).drop("dataset_id"), document_sets(spark, sf_dir))
    return got.select("id", F.size("record_sets").cast("bigint").alias("n_record_sets"), F.col("record_sets")[0]["num_words"].alias("words"))


_ORDERS = {"o_orderkey": "sc:Integer", "o_custkey": "sc:Integer", "o_orderstatus": "sc:Text", "o_totalprice": "sc:Float", "o_orderdate": "sc:Date", "o_orderpriority": "sc:Text"}


@query(
    "column_fields",
    "WITH s AS (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR)) AS r FROM orders), e AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 30)"
    + " UNION ALL ".join(
        f" SELECT 'orders' AS record_set, {i} AS position, '{c}' AS name, '{k}' AS data_type, 'orders.csv' AS file, (SELECT count(DISTINCT {c}) FROM orders) AS unique_count,"
        f" {'(SELECT string_agg(' + c + '::VARCHAR, chr(44) ORDER BY r) FROM s WHERE r <= 10)' if k != 'sc:Float' and k != 'sc:Date' else 'NULL'} AS sample,"
        f" (SELECT to_json(list(o_orderkey ORDER BY o_orderkey))::VARCHAR FROM e) AS key_examples"
        for i, (c, k) in enumerate(_ORDERS.items())
    ),
)
def column_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record set of a table: for each column its source, sample and statistics, and the examples of the whole table."""
    orders = table(spark, sf_dir, "orders")
    prof = C.profile_tables({"orders": orders.select(*_ORDERS)}).withColumns({"dataset_id": F.lit("sales"), "distribution_id": F.lit("orders.csv")})
    sets = A.column_fields(prof, C.value_sample(orders, F.md5(F.col("o_orderkey").cast("string")), list(_ORDERS)))
    f = A.with_examples(sets, C.table_examples(orders, "o_orderkey", list(_ORDERS))).select("record_set", F.explode("fields").alias("f"), F.get_json_object("examples", "$.o_orderkey").alias("key_examples"))
    sample = F.when(~F.col("f.data_type").isin("sc:Float", "sc:Date"), F.array_join("f.sample", ","))
    return f.select(
        "record_set", "f.position", F.col("f.source.extract.column").alias("name"), "f.data_type", F.col("f.source.fileObject").alias("file"), F.col("f.statistics.unique_count").alias("unique_count"), sample.alias("sample"), "key_examples"
    )


@query(
    "database_record_sets",
    """SELECT event_type AS table_name, sha256(sha256('postgresql://db:5432/events') || '/' || event_type) AS distribution_id, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type
UNION ALL SELECT event_type, NULL, count(*) FROM events WHERE event_type = 'click' GROUP BY event_type""",
)
def database_record_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tables of a database, one of which the inventory lacks."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
    names = e.filter("table_name <> 'click'").select(F.lit("events").alias("database_name"), "table_name")
    connection = names.select(F.lit("postgresql").alias("protocol"), F.lit("db").alias("host"), F.lit(5432).alias("port"), "database_name").distinct()
    return A.database_record_sets(e, I.database_distributions(connection, names)).select("table_name", "distribution_id", "n")


_SHOP = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}
_SHOP_URL = "postgresql://db:5432/shop"


def shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The record sets and the inventory of a database of two tables."""
    tables = {t: table(spark, sf_dir, t).select(*cs) for t, cs in _SHOP.items()}
    names = spark.createDataFrame([("shop", t) for t in _SHOP], "database_name string, table_name string")
    connection = names.select(F.lit("postgresql").alias("protocol"), F.lit("db").alias("host"), F.lit(5432).alias("port"), "database_name").distinct()
    dists = I.database_distributions(connection, names)
    return A.database_tables(tables, {t: cs[0] for t, cs in _SHOP.items()}, dists, "sales"), dists


def _sql_shop(rest: str) -> str:
    """A SELECT for each column of the shop; ``rest`` with {t} table, {k} key, {c} column, {i} position, {kind} type, {most} largest number."""
    parts = []
    for t, cs in _SHOP.items():
        for i, c in enumerate(cs):
            number = c.endswith("key")
            parts.append(rest.format(t=t, k=cs[0], c=c, i=i, kind="sc:Integer" if number else "sc:Text", most=f"(SELECT max({c})::DOUBLE FROM {t})" if number else "NULL::DOUBLE"))
    return " UNION ALL ".join(parts)


@query(
    "database_tables",
    _sql_shop(
        f"""SELECT '{{t}}' AS table_name, sha256(sha256('{_SHOP_URL}') || '/{{t}}') AS distribution_id, {{i}} AS position, '{{c}}' AS column_name, '{{kind}}' AS data_type, '{{c}}' AS source_column,
(SELECT string_agg(v::VARCHAR, ',' ORDER BY v::VARCHAR) FROM (SELECT DISTINCT {{c}} AS v FROM (SELECT {{c}} FROM {{t}} ORDER BY {{k}} LIMIT 1000) ORDER BY v LIMIT 3)) AS sample,
(SELECT count({{c}}) FROM {{t}}) AS row_count, (SELECT count(DISTINCT {{c}}) FROM {{t}}) AS unique_count, (SELECT to_json(list({{c}} ORDER BY {{k}}))::VARCHAR FROM (SELECT * FROM {{t}} ORDER BY {{k}} LIMIT 30)) AS examples"""
    ),
)
def database_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a database with their columns' types, values, statistics and examples."""
    sets, _ = shop(spark, sf_dir)
    f = sets.select("table_name", "distribution_id", "examples", F.explode("fields").alias("f"))
    return f.select(
        "table_name", "distribution_id", "f.position", F.col("f.name").alias("column_name"), "f.data_type", F.col("f.source.extract.column").alias("source_column"), F.array_join("f.sample", ",").alias("sample"),
        F.col("f.statistics.row_count").alias("row_count"), F.col("f.statistics.unique_count").alias("unique_count"), F.variant_get(F.parse_json("examples"), F.concat(F.lit("$."), "f.name"), "string").alias("examples"),
    )


@query(
    "flat_databases",
    _sql_shop(
        f"SELECT 'sales' AS dataset_id, sha256('{_SHOP_URL}') AS file_object_id, 'sql-db' AS original_format, '{_SHOP_URL}' AS source_file, 'shop' AS name, '{{t}}' AS table_name, '{{c}}' AS column_name, '{{kind}}' AS primitive_type,"
        " (SELECT count({c}) FROM {t}) AS row_count, {most} AS max_value"
    ),
)
def flat_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat form of a database: its tables, nested, with their columns."""
    flat = A.flat_databases(*shop(spark, sf_dir)).select("dataset_id", "file_object_id", "original_format", "source_file", "name", F.explode("tables").alias("t"))
    c = flat.select("*", F.col("t.name").alias("table_name"), F.explode("t.columns").alias("c"))
    return c.select("dataset_id", "file_object_id", "original_format", "source_file", "name", "table_name", F.col("c.name").alias("column_name"), "c.primitive_type", F.col("c.statistics.row_count").alias("row_count"), F.col("c.statistics.max_value").alias("max_value"))

"""Profiles as nested records: light (what there is), heavy (with all record sets), flat (by file)."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import columns as C

# Fields of a dataset's top level, as arrays or single strings.
LIST_FIELDS = ("keywords", "fieldOfScience", "inLanguage")
TEXT_FIELDS = ("id", "name", "description", "headline", "conformsTo", "citeAs", "license", "url", "doi", "version", "country", "datePublished", "uploadedBy")

# Prefixes, forms and terms of the vocabularies in the light and heavy profile. What
# begins with dg: belongs to an extension vocabulary, whose address the caller gives.
CONTEXT = {
    "@language": "en",
    "@vocab": "https://schema.org/",
    "sc": "https://schema.org/",
    "cr": "http://mlcommons.org/croissant/",
    "rai": "http://mlcommons.org/croissant/RAI/",
    "dct": "http://purl.org/dc/terms/",
    "wd": "https://www.wikidata.org/wiki/",
    "data": {"@id": "cr:data", "@type": "@json"},
    "dataType": {"@id": "cr:dataType", "@type": "@vocab"},
    "examples": {"@id": "cr:examples", "@type": "@json"},
    "access": "dg:access",
    "citeAs": "cr:citeAs",
    "column": "cr:column",
    "conformsTo": "dct:conformsTo",
    "containedIn": "cr:containedIn",
    "doi": "dg:doi",
    "extract": "cr:extract",
    "field": "cr:field",
    "fieldOfScience": "dg:fieldOfScience",
    "fileObject": "cr:fileObject",
    "fileProperty": "cr:fileProperty",
    "fileSet": "cr:fileSet",
    "format": "cr:format",
    "generatedAt": "dg:generatedAt",
    "histogram": "dg:histogram",
    "includes": "cr:includes",
    "isLiveDataset": "cr:isLiveDataset",
    "jsonPath": "cr:jsonPath",
    "key": "cr:key",
    "max": "dg:max",
    "md5": "cr:md5",
    "mean": "dg:mean",
    "median": "dg:median",
    "min": "dg:min",
    "missingCount": "dg:missingCount",
    "missingPercentage": "dg:missingPercentage",
    "parentField": "cr:parentField",
    "path": "cr:path",
    "percentile05": "dg:percentile05",
    "percentile95": "dg:percentile95",
    "range": "dg:range",
    "recordSet": "cr:recordSet",
    "references": "cr:references",
    "regex": "cr:regex",
    "repeated": "cr:repeated",
    "replace": "cr:replace",
    "rowCount": "dg:rowCount",
    "separator": "cr:separator",
    "source": "cr:source",
    "standardDeviation": "dg:standardDeviation",
    "statistics": "dg:statistics",
    "status": "dg:status",
    "subField": "cr:subField",
    "transform": "cr:transform",
    "uniqueCount": "dg:uniqueCount",
    "uploadedBy": "dg:uploadedBy",
    "variance": "dg:variance",
}


def context_json(extension_vocabulary: str = "") -> str:
    """The JSON-LD context; the vocabulary behind prefix dg is the caller's."""
    return json.dumps(CONTEXT | {"dg": extension_vocabulary}, separators=(",", ":"))


def top_level(spec: DataFrame, root: str = "") -> DataFrame:
    """(dataset_id, dataset): a struct of a specification's fields; missing ones are null or empty arrays."""
    have = set(spec.columns)
    text = [(F.col(f) if f in have else F.lit(None).cast("string")).alias(f) for f in TEXT_FIELDS]
    lists = [(F.col(f) if f in have else F.array().cast("array<string>")).alias(f) for f in LIST_FIELDS]
    extra = [F.concat(F.lit(root), "id").alias("archivedAt"), F.lit("").alias("access"), F.lit("loaded").alias("status")]
    return spec.select(F.col("id").alias("dataset_id"), F.struct(*text, *lists, *extra).alias("dataset"))


def distribution_record() -> Column:
    return F.struct("kind", "id", "name", "content_size", "content_url", "encoding_format", F.col("path_sha256").alias("sha256"), "contained_in", "includes")


def profile_records(top: DataFrame, dists: DataFrame, sets: DataFrame | None = None, extension_vocabulary: str = "") -> DataFrame:
    """(dataset_id, part, id, json): a profile as records, one for the dataset (with its context), one for each distribution and record set.

    This is the form for datasets of any size: nothing is gathered in one row, and the table can be partitioned by dataset.
    ``sets`` None gives the light profile; else it has ``id``, and what else belongs to a record set.
    Minimal distributions are left out.
    """
    options = {"ignoreNullFields": "false"}
    whole = lambda c: F.to_json(c, options)
    context = F.lit('{"@context":' + context_json(extension_vocabulary) + ",")
    datasets = top.select("dataset_id", F.lit("dataset").alias("part"), F.col("dataset.id").alias("id"), F.concat(context, F.substring(whole(F.col("dataset")), F.lit(2), F.lit(2**31 - 1))).alias("json"))
    listed = dists.filter(~F.col("is_minimal")).select("dataset_id", F.lit("distribution").alias("part"), "id", whole(distribution_record()).alias("json"))
    out = datasets.unionByName(listed)
    if sets is not None:
        out = out.unionByName(sets.select("dataset_id", F.lit("recordSet").alias("part"), "id", whole(F.struct(*[c for c in sets.columns if c != "dataset_id"])).alias("json")))
    return out


def light_profile(top: DataFrame, dists: DataFrame) -> DataFrame:
    """One row per dataset: its top level and an array of its distributions, by kind and id, minimal ones left out.

    A row holds a whole dataset: for ones of more than some 100,000 files take ``profile_records``.
    """
    kept = dists.filter(~F.col("is_minimal"))
    listed = kept.groupBy("dataset_id").agg(F.sort_array(F.collect_list(distribution_record())).alias("distribution"))
    return top.join(listed, "dataset_id", "left")


def column_fields(profiles: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(dataset_id, distribution_id, record_set, fields): a table's column profiles, nested in column order.

    Each field has its source (file and column), its statistics and a sample: values of
    ``samples`` (column_name, rank, value), none if it isn't given.
    """
    outside = ("dataset_id", "distribution_id", "table_name", "column_name", "data_type", "position", "sample")
    if samples is None:
        sampled = profiles.withColumn("sample", F.array().cast("array<string>"))
    else:
        values = samples.groupBy("column_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample"))
        sampled = profiles.join(F.broadcast(values), "column_name", "left")  # a row for each column
    source = F.struct(F.col("distribution_id").alias("fileObject"), F.struct(F.col("column_name").alias("column")).alias("extract"))
    statistics = F.struct(*[c for c in profiles.columns if c not in outside])
    field = F.struct("position", F.col("column_name").alias("name"), F.lit("").alias("description"), "data_type", source.alias("source"), "sample", statistics.alias("statistics"))
    return sampled.groupBy("dataset_id", "distribution_id", F.col("table_name").alias("record_set")).agg(F.sort_array(F.collect_list(field)).alias("fields"))


def with_examples(sets: DataFrame, examples: DataFrame) -> DataFrame:
    """A table's record set with its examples (column_name, examples) as one JSON object, by column name."""
    entry = F.concat(F.to_json(F.array("column_name")).substr(F.lit(2), F.char_length(F.to_json(F.array("column_name"))) - 2), F.lit(":"), "examples")
    listed = examples.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("examples"))
    return sets.crossJoin(F.broadcast(listed))


def sheet_distributions(workbooks: DataFrame, sheets: DataFrame) -> DataFrame:
    """A distribution for each sheet (distribution_id, sheet_name) that a record set came from, contained in its workbook."""
    files = workbooks.select(F.col("id").alias("distribution_id"), *(c for c in ("dataset_id", "encoding_format") if c in workbooks.columns))
    made = sheets.select("distribution_id", "sheet_name").distinct().join(files, "distribution_id")
    return made.select(
        F.sha2(F.concat_ws("/", "distribution_id", "sheet_name"), 256).alias("id"),
        F.lit("sheet").alias("kind"),
        F.col("sheet_name").alias("name"),
        "encoding_format",
        F.col("distribution_id").alias("contained_in"),
        F.lit(False).alias("is_minimal"),
        *(c for c in ("dataset_id",) if c in workbooks.columns),
    )


def record_sets(*parts: DataFrame) -> DataFrame:
    """Record sets of tables, databases and documents together; each part keeps its own columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def heavy_profile(light: DataFrame, sets: DataFrame) -> DataFrame:
    """The light profile with an array of all record sets, in the order of their columns; for bounded datasets, as ``light_profile``."""
    payload = [c for c in sets.columns if c != "dataset_id"]
    nested = sets.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("recordSet"))
    return light.join(nested, "dataset_id", "left")


def matched(dists: DataFrame, sets: DataFrame) -> DataFrame:
    """Each distribution that has record sets, with the array of them."""
    payload = [c for c in sets.columns if c not in ("dataset_id", "distribution_id")]
    nested = sets.groupBy("distribution_id").agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("record_sets"))
    return dists.join(nested, dists["id"] == nested["distribution_id"])


def without_record_sets(dists: DataFrame, sets: DataFrame) -> DataFrame:
    """Files that no record set came from; tables of databases are no files."""
    files = dists.filter(F.col("kind").isin("file", "file_in_set"))
    databases = dists.filter("kind = 'database'").select(F.col("id").alias("contained_in"))
    return files.join(databases, "contained_in", "left_anti").join(sets.select(F.col("distribution_id").alias("id")), "id", "left_anti")


def database_record_sets(tables: DataFrame, dists: DataFrame) -> DataFrame:
    """Tables with the id of their distribution, by name; null for a table that has none."""
    ids = dists.filter("kind = 'database_table'").select(F.col("name").alias("table_name"), F.col("id").alias("distribution_id"))
    return tables.join(ids, "table_name", "left")


def database_tables(tables: dict[str, DataFrame], keys: dict[str, str], dists: DataFrame, dataset_id: str, values: int = 3, scan: int = 1000, rows: int = 30) -> DataFrame:
    """(dataset_id, distribution_id, table_name, fields, examples): the record set of each table of a database.

    Each column has its type, its source (the table's distribution), up to ``values`` different values of the first ``scan`` rows by the
    table's key, and its exact statistics over all rows; ``examples`` are the first ``rows`` rows as JSON, by column. A table that
    the inventory lacks has no distribution.
    """
    ids = dists.filter("kind = 'database_table'").select(F.col("name").alias("table_name"), F.col("id").alias("distribution_id"))
    parts = []
    for name, df in tables.items():
        profiles = C.profile_columns(df).select(F.lit(name).alias("table_name"), "*").join(F.broadcast(ids), "table_name", "left").withColumn("dataset_id", F.lit(dataset_id))
        picked = [C.distinct_value_sample(df, c, keys[name], values, scan) for c in df.columns]
        samples = reduce(DataFrame.unionByName, picked).withColumn("rank", F.lit(0))
        parts.append(with_examples(column_fields(profiles, samples), C.table_examples(df, keys[name], rows=rows)).withColumnRenamed("record_set", "table_name"))
    return reduce(DataFrame.unionByName, parts)


def flat_databases(sets: DataFrame, dists: DataFrame) -> DataFrame:
    """One row per database: (dataset_id, file_object_id, original_format, source_file, name, tables), its tables with their columns' names, types and statistics."""
    columns = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["data_type"].alias("primitive_type"), f["description"].alias("description"), f["statistics"].alias("statistics")))
    within = dists.filter("kind = 'database_table'").select(F.col("id").alias("distribution_id"), "contained_in")
    nested = sets.join(within, "distribution_id").groupBy("dataset_id", "contained_in").agg(F.sort_array(F.collect_list(F.struct(F.col("table_name").alias("name"), columns.alias("columns")))).alias("tables"))
    whole = dists.filter("kind = 'database'").select(F.col("id").alias("contained_in"), F.col("content_url").alias("source_file"), "name")
    return nested.join(whole, "contained_in").select("dataset_id", F.col("contained_in").alias("file_object_id"), F.lit("sql-db").alias("original_format"), "source_file", "name", "tables")


def flat_files(dists: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per file, of any number: (dataset_id, file_object_id, source_file, name, encoding_format, tables), with the record sets found in it."""
    payload = [c for c in sets.columns if c not in ("dataset_id", "distribution_id")]
    nested = sets.groupBy("distribution_id").agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("tables"))
    kind = nested.schema["tables"].dataType.simpleString()
    files = dists.filter(F.col("kind").isin("file", "file_in_set", "database")).join(nested, dists["id"] == nested["distribution_id"], "left")
    return files.select("dataset_id", F.col("id").alias("file_object_id"), F.col("content_url").alias("source_file"), "name", "encoding_format", F.coalesce("tables", F.array().cast(kind)).alias("tables"))


def flat_profile(top: DataFrame, dists: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per dataset: its top level and ``files`` by id, each with the record sets found in it (an empty array if none); for bounded datasets."""
    files = flat_files(dists, sets)
    entry = F.struct(*[c for c in files.columns if c != "dataset_id"])
    return top.join(files.groupBy("dataset_id").agg(F.sort_array(F.collect_list(entry)).alias("files")), "dataset_id", "left")


def as_json(profile: DataFrame, extension_vocabulary: str | None = None) -> DataFrame:
    """(dataset_id, json): each profile as one JSON text; with the context if an extension vocabulary is given."""
    body = F.to_json(F.struct(*[c for c in profile.columns if c != "dataset_id"]))
    if extension_vocabulary is not None:
        body = F.concat(F.lit('{"@context":' + context_json(extension_vocabulary) + ","), F.substring(body, F.lit(2), F.lit(2**31 - 1)))
    return profile.select("dataset_id", body.alias("json"))

"""Inventory of the files behind a dataset: distributions of files, file sets and databases.

All of it works on a listing, one row per file with ``path`` and ``length``: from a directory scan,
an object store's inventory or any table that has these columns.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Media types by file extension.
MEDIA_TYPES = {
    ".csv": "text/csv", ".sql": "text/sql", ".db": "text/sql", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel", ".pdf": "application/pdf", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".xml": "application/xml",
    ".json": "application/json", ".jsonl": "application/jsonl", ".md": "text/markdown",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".ipynb": "application/x-ipynb+json",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
}

# Profilers by file extension.
PROFILERS = {".csv": "table", ".xlsx": "workbook", ".xls": "workbook", ".pdf": "pdf", ".txt": "text"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]+/*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one. A leading dot makes a hidden file, not an extension."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension(path)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def media_type(path: Column) -> Column:
    """Null for extensions that are not supported."""
    return _lookup(MEDIA_TYPES, extension(path))


def profiler_kind(path: Column) -> Column:
    """Which profiler a file goes to; null if none does."""
    return _lookup(PROFILERS, extension(path))


def stable_id(*parts: Column) -> Column:
    """An id that is the same in every run."""
    return F.sha2(F.concat_ws("/", *parts), 256)


def size_label(size: Column) -> Column:
    return F.concat(size.cast("string"), F.lit(" B"))


def file_distributions(files: DataFrame, root: str) -> DataFrame:
    """One row per file under ``root``; files in subdirectories belong to the file set of their directory.

    ``is_minimal`` marks files of unsupported types; those directly under the root are not distributions
    and are left out.
    """
    p = F.col("path")
    top = parent_dir(p) == F.lit(root.rstrip("/"))
    rows = files.select(
        stable_id(p).alias("id"),
        F.when(top, "file").otherwise("file_in_set").alias("kind"),
        file_name(p).alias("name"),
        F.col("length").alias("size_bytes"),
        size_label(F.col("length")).alias("content_size"),
        p.alias("content_url"),
        media_type(p).alias("encoding_format"),
        F.sha2(p, 256).alias("path_sha256"),
        F.when(~top, stable_id(parent_dir(p))).alias("contained_in"),
        media_type(p).isNull().alias("is_minimal"),
        profiler_kind(p).alias("profiler_kind"),
    )
    return rows.filter("not (is_minimal and kind = 'file')")


def unsupported_files(files: DataFrame) -> DataFrame:
    """(path, extension) of the files that no media type is known for."""
    p = F.col("path")
    return files.filter(media_type(p).isNull()).select("path", extension(p).alias("extension"))


def file_sets(files: DataFrame, root: str) -> DataFrame:
    """One row per directory under ``root`` with a supported file: summed size, media type and profiler of its first one."""
    p = F.col("path")
    base = root.rstrip("/")
    inside = files.filter(p.startswith(base + "/") & (parent_dir(p) != base))
    grouped = inside.groupBy(parent_dir(p).alias("dir")).agg(
        F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("n_files"), F.min(F.when(media_type(p).isNotNull(), p)).alias("first")
    )
    return grouped.filter("first is not null").select(
        stable_id(F.col("dir")).alias("id"),
        F.lit("file_set").alias("kind"),
        file_name(F.col("dir")).alias("name"),
        "size_bytes",
        size_label(F.col("size_bytes")).alias("content_size"),
        F.col("dir").alias("content_url"),
        media_type(F.col("first")).alias("encoding_format"),
        profiler_kind(F.col("first")).alias("profiler_kind"),
        F.concat(file_name(F.col("dir")), F.lit("/*")).alias("includes"),
        "n_files",
        F.lit(False).alias("is_minimal"),
    )


def database_distributions(connections: DataFrame, catalog: DataFrame) -> DataFrame:
    """Connections (protocol, host, port, database_name) and, contained in each, its tables."""
    url = F.concat("protocol", F.lit("://"), "host", F.lit(":"), F.col("port").cast("string"), F.lit("/"), "database_name")
    made = connections.select(
        stable_id(url).alias("id"), F.lit("database").alias("kind"), F.col("database_name").alias("name"), url.alias("content_url"), F.lit("text/sql").alias("encoding_format"), F.lit(False).alias("is_minimal")
    )
    names = catalog.select("database_name", "table_name").distinct()
    tables = names.join(made.select(F.col("name").alias("database_name"), F.col("id").alias("contained_in")), "database_name").select(
        stable_id(F.col("contained_in"), F.col("table_name")).alias("id"),
        F.lit("database_table").alias("kind"),
        F.col("table_name").alias("name"),
        F.lit("text/sql").alias("encoding_format"),
        "contained_in",
        F.lit(False).alias("is_minimal"),
    )
    return made.unionByName(tables, allowMissingColumns=True)


def distributions(files: DataFrame, root: str, databases: DataFrame | None = None) -> DataFrame:
    """File sets, databases and their tables, files, and files in sets, told apart by ``kind``."""
    out = file_sets(files, root).unionByName(file_distributions(files, root), allowMissingColumns=True)
    return out if databases is None else out.unionByName(databases, allowMissingColumns=True)


def counts_by_kind(dists: DataFrame) -> DataFrame:
    return dists.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def with_digests(dists: DataFrame, digests: DataFrame) -> DataFrame:
    """``dists`` with the ``content_sha256`` of each file, from (path, content_sha256) as ``files.digests`` gives it; null for what is no file."""
    found = digests.select(F.col("path").alias("content_url"), "content_sha256")
    return dists.join(found, "content_url", "left").select(*dists.columns, "content_sha256")

"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. Stages that drop rows tell them apart by a number of their own,
so rows that share an id, have none or are repeated are judged one by one. An empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import decontam, exact, mixing, near, quality
from plumbline.llm.common import checked_broadcast, only_ids, table, written

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the first of its like that is no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and its name: the row's place in its file, after the number of that file.

    That doesn't depend on how files are split, so it stays when executors come or go. Rows that are not from files are written first.
    """
    row, path, file = (free_name(docs, n) for n in ("_row", "_path", "_file"))
    try:
        where = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    files = where.select(path).distinct().withColumn(file, F.row_number().over(Window.orderBy(path)))
    place = F.shiftleft(F.col(file).cast("bigint"), 40) + F.col(row)
    return where.join(checked_broadcast(written(files, "files")), path).withColumn(row, place).select(*docs.columns, row), row


def without(docs: DataFrame, row: str, gone: DataFrame, label: str) -> DataFrame:
    """The numbered ``docs`` without the rows whose numbers are in ``gone``, and without the number."""
    return only_ids(docs, row, written(gone, label), "left_anti").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is ``LEAST_QUALITY`` or more.

    Null and empty texts are scored as texts of no words; rows without an id are scored like all
    others. Repeated rows get equal scores. Very long texts are scored whole.
    """
    score = free_name(docs, "_score")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.with_quality(docs, model, score_col=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest id, the last one if it is repeated.

    Null texts are empty ones, so one of all these stays. A row without an id stays only if no row of
    its group has one.
    """
    rows, row = numbered(docs)
    keys = rows.select(F.struct("doc_id", row).alias("key"), "text")
    gone = exact.exact_dedup(keys, id_col="key").filter("not kept").select(F.col("key")[row].alias("row"))
    return without(rows, row, gone, "exact-gone")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of the smallest id, the first one if it is repeated.

    Null, empty and wordless texts are one class. A row without an id comes after all others of its class.
    """
    rows, row = numbered(docs)
    found = near.near_duplicates(rows.select(row, "text"), id_col=row).filter("class_size > 1").select(row, "class_id")
    found = written(found.join(rows.select(row, "doc_id"), row), "near-classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    stays = found.groupBy("class_id").agg(F.min(order)[row].alias("stays"))
    gone = found.select(row).join(stays, found[row] == stays["stays"], "left_anti")
    return without(rows, row, gone, "near-gone")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. Null, empty and wordless texts hold none and stay; repeated rows go or stay together."""
    rows, row = numbered(docs)
    gone = decontam.contaminated(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), id_col=row).select(row).distinct()
    return without(rows, row, gone, "leaks-gone")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the number of its copies in the mix and its place in the first pass.

    The null source is one of its own; null and empty texts cost one token; repeated rows and rows without an
    id have equal places.
    """
    mixed = mixing.mix_sources(docs)
    first = F.col("schedule")[0]
    return mixed.select("doc_id", "source", "n_tokens", "weight", "copies", first["block_key"].alias("block_key"), first["doc_key"].alias("doc_key"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: A trained network and Order MinHash classes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

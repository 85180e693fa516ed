"""Where profiles are kept: JSON per dataset, a partitioned table, and a catalog of the newest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.session import few_listing_tasks


def write_json(profiles: DataFrame, path: str) -> None:
    """(dataset_id, json) as text files, a directory per dataset."""
    profiles.select("dataset_id", "json").write.mode("overwrite").partitionBy("dataset_id").text(path)


def put(profiles: DataFrame, path: str) -> None:
    """Add profiles to the table; only the partitions of their datasets are replaced."""
    profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def get(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    """A dataset's profile; the other partitions are not read."""
    return spark.read.parquet(path).filter(F.col("dataset_id") == dataset_id)


def newest(profiles: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """The newest row of each id. Rows of an id are reduced in each task before any are shuffled."""
    best = profiles.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max_by(F.struct(*profiles.columns), F.col(time_col)).alias("p"))
    return best.select("p.*")


def newest_ranked(profiles: DataFrame, id_col: str, time_col: str, tie_col: str) -> DataFrame:
    """The newest row of each id; of rows of the same time the one of largest ``tie_col``."""
    w = W.partitionBy(id_col).orderBy(F.desc(time_col), F.desc(tie_col))
    return profiles.filter(F.col(id_col).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def compact(spark: SparkSession, path: str, id_field: str = "@id", recursive: bool = False) -> DataFrame:
    """(dataset_id, path, modified) of the newest profile file of each id; unreadable files and those without one are left out."""
    with few_listing_tasks(spark):
        texts = spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True)
    files = texts.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    found = files.select(F.get_json_object("value", f"$['{id_field}']").alias("dataset_id"), "path", "modified", F.try_parse_json("value").isNotNull().alias("ok"))
    return newest_ranked(found.filter("ok").drop("ok"), "dataset_id", "modified", "path")

"""Incremental processing: a manifest of finished files, so that a run reads only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "path string, length long, modified timestamp, night string, ordinal int, rows long"
#: Night and time in a file's name: the integer part of a Julian date and its decimals.
JULIAN = r"([0-9]{5,})\.([0-9]+)"


def listing(spark: SparkSession, folder: str, pattern: str = "*.parquet", julian: str = JULIAN) -> DataFrame:
    """(path, length, modified, night, ordinal, first) of a folder's files; contents are not read.

    night is the integer Julian date in the name (empty without one), ordinal
    the file's place in its night by name, first whether that is 0.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    files = files.select("path", "length", F.col("modificationTime").alias("modified"))
    files = files.withColumn("night", F.regexp_extract("path", julian + r"[^/]*$", 1))
    order = F.row_number().over(Window.partitionBy("night").orderBy("path")) - 1
    return files.withColumn("ordinal", order.cast("int")).withColumn("first", F.col("ordinal") == 0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def unseen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest lacks, or has with another length or time of change."""
    return files.join(manifest.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def run_new(spark: SparkSession, folder: str, manifest: str, step: Callable[[DataFrame], None], pattern: str = "*.parquet", only_first: bool = False) -> DataFrame:
    """Calls step with the rows of the new files, in order of night and name, then adds them to the manifest; returns those entries.

    step writes its results; if it fails the manifest stays as it is and the
    next run takes the files again. Entries hold the rows of each file. With
    only_first nothing runs unless a night's first file is among the new ones.
    """
    new = unseen(listing(spark, folder, pattern), read_manifest(spark, manifest)).orderBy("night", "ordinal")
    found = new.collect()  # names of new files, which the scan's planner holds too
    if not found or (only_first and not any(r["first"] for r in found)):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.parquet(*[r["path"] for r in found])
    step(rows)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    entries = spark.createDataFrame([tuple(r[c] for c in ("path", "length", "modified", "night", "ordinal")) for r in found], MANIFEST.removesuffix(", rows long"))

    def bare(c: str):
        return F.regexp_replace(c, "^file:/*", "/")

    entries = entries.join(counts.withColumn("_at", bare("file")), bare("path") == F.col("_at"), "left").select("path", "length", "modified", "night", "ordinal", F.coalesce("rows", F.lit(0)).alias("rows"))
    entries.write.mode("append").parquet(manifest)
    return entries

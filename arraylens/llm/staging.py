"""Intermediate tables in the shared checkpoint folder, and input helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, whatever rows hold: a row of a number or a whole text, one row at least.
BATCH_BYTES = 1 << 20
#: Spark's setting by which a query's shuffle files go when it ends; without it they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where unset, a temporary one on a local master and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="arraylens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stage:
    """Tables written during one operator call, all under one folder.

    A table is written once as Parquet and read back, which cuts lineage: a
    lost executor costs the tasks it ran and never a recomputation of the whole
    operator. Its shuffle files go once it is written. ``drop`` removes a table
    that later steps no longer read, ``only`` all but those that they read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/arraylens/{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()

    def keep(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        given = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            if given is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, given)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.delete(df._stage_path)

    def only(self, *frames: DataFrame) -> None:
        for path in self.paths - {df._stage_path for df in frames}:
            self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        self.paths.discard(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes. It is one value for all stages, so a lazy result runs as it was planned."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores added while they clash with `names` in any case."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` long and ``text`` string, whatever else the input has."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )

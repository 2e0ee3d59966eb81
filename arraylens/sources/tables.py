"""Readers and writers of the canonical tables.

Tables are Parquet, partitioned by observation; metric files in JSON can be
imported. Pickles are not read, as loading them runs code.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylens import schema


def read_vis(spark: SparkSession, *paths: str, correlations: str = "both", cross_pol: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Visibilities of one or several files; correlations: cross, auto or both. Filters and columns reach the scan."""
    if correlations not in ("cross", "auto", "both"):
        raise ValueError(f"unknown correlations {correlations!r}")
    df = spark.read.schema(schema.VIS).parquet(*paths)
    same_pol = F.substring("pol", 1, 1) == F.substring("pol", 2, 1)
    if correlations == "auto":
        df = df.where("ant1 = ant2")
    elif correlations == "cross":
        df = df.where("ant1 <> ant2")
    if not cross_pol:
        df = df.where(same_pol)
    return df.select(*columns) if columns else df


def read_autos(spark: SparkSession, *paths: str) -> DataFrame:
    """(ant, pol, time_idx, chan, v): same-feed autocorrelations of all files."""
    df = read_vis(spark, *paths, correlations="auto", cross_pol=False)
    return df.select(F.col("ant1").alias("ant"), "pol", "time_idx", "chan", F.hypot("re", "im").alias("v"))


def only_autos(df: DataFrame) -> DataFrame:
    """df, or an error when it runs, if a row is no same-feed autocorrelation."""
    ok = (F.col("ant1") == F.col("ant2")) & (F.substring("pol", 1, 1) == F.substring("pol", 2, 1))
    return df.withColumn("ant1", F.when(F.assert_true(ok, "only same-feed autocorrelations are allowed").isNull(), F.col("ant1")))


def read_pairs(spark: SparkSession, sums: Sequence[str], diffs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sum and difference files, as many of each."""
    if len(sums) != len(diffs):
        raise AssertionError("as many sum as difference files are needed")
    return read_vis(spark, *sums), read_vis(spark, *diffs)


def read_cal(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(schema.CAL).parquet(*paths)


def baselines(vis: DataFrame) -> DataFrame:
    """The distinct baselines; only their three columns are scanned."""
    return vis.select("ant1", "ant2", "pol").distinct()


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), overwrite: bool = False, history: str = "", version: str = "1") -> None:
    """Writes a table, with its provenance beside it; refuses to overwrite unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(f"{path.rstrip('/')}/data")
    row = [(history, version)]
    df.sparkSession.createDataFrame(row, "history string, version string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/provenance")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/data")


def write_products(products: DataFrame, path: str, overwrite: bool = False) -> None:
    """All products of a run in one partitioned write by observation and product."""
    write_table(products, path, ("obs", "product"), overwrite)


_KEY = r"^\(?\s*\(?\s*(\d+)\s*,\s*'?\"?([A-Za-z]+)'?\"?\s*\)?\s*\)?$"


def read_metric_json(spark: SparkSession, path: str) -> DataFrame:
    """(metric, ant, antpol, iter, value) of a JSON metric file of nested dictionaries keyed by "(ant, pol)".

    One file holds an array's metrics and is read by the driver; keys that are no
    antenna go with a null ant.
    """
    tree = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    rows: list[tuple] = []
    import re

    def walk(name: str, x, ant=None, pol=None, n=None) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                m = re.match(_KEY, str(k))
                if m:
                    walk(name, v, int(m[1]), m[2], n)
                elif str(k).isdigit():
                    walk(name, v, ant, pol, int(k)) if ant is not None or n is None else walk(name, v, int(k), pol, n)
                else:
                    walk(f"{name}_{k}" if name else str(k), v, ant, pol, n)
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            rows.append((name, ant, pol, n, float(x)))
        elif isinstance(x, str):
            try:
                rows.append((name, ant, pol, n, float(x)))
            except ValueError:
                pass

    walk("", tree)
    return spark.createDataFrame(rows, schema.ANT_METRIC)


def export_metrics(metrics: DataFrame, excluded: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(per antenna, per array): (metric, ant, antpol, value) with the last finite value of each metric, and scalars.

    Excluded antennas become metrics of their own, with value 1.
    """
    last = metrics.where("value is not null and not isnan(value)").groupBy("metric", "ant", "antpol").agg(F.max_by("value", F.coalesce("iter", F.lit(0))).alias("value"))
    named = last.select(F.concat(F.lit(f"{prefix}_"), "metric").alias("metric"), "ant", "antpol", "value")
    flags = excluded.select(F.concat(F.lit(f"{prefix}_"), "reason").alias("metric"), "ant", "antpol", F.lit(1.0).alias("value"))
    steps = excluded.select(F.lit(f"{prefix}_removal_iter").alias("metric"), "ant", "antpol", F.col("removal_iteration").cast("double").alias("value"))
    return (
        named.where("ant is not null").unionByName(flags).unionByName(steps),
        named.where("ant is null").select("metric", F.col("antpol").alias("pol"), "value"),
    )

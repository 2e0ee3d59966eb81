"""Nights of many observations: integrations numbered through the night, and filters on chunks with halos.

A table of a night has `night`, `obs` and `time_idx`, which numbers the
integrations of the night through its observations. A filter of an observation
must see some integrations of its neighbours: their rows are copied into its
chunk, the filter runs on the chunk, and only the rows at home are kept. So no
task holds more than an observation and its halo, however long the night is, and
the result is that of the whole night.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arraylens.operators import grouped, kernels

#: Integrations around a pixel that an algorithm's value depends on, by its half width in time.
REACH: dict[str, Callable[[int], int]] = {
    "detrend_medfilt": lambda kt: 2 * kt,
    "detrend_meanfilt": lambda kt: 2 * kt,
    "detrend_medminfilt": lambda kt: 2 * (2 * kt + 1),
    "medminfilt": lambda kt: kt,
}


def numbered(df: DataFrame, night: str = "night", obs: str = "obs", time: str = "time_idx", out: str = "time_idx") -> DataFrame:
    """df, whose times are numbered by observation, with times numbered through each night in order of observations.

    Only the distinct times are ordered: one row an integration, whatever the number of baselines and channels.
    """
    times = df.select(night, obs, time).distinct()
    order = F.row_number().over(Window.partitionBy(night).orderBy(obs, time)) - 1
    times = times.select(night, obs, F.col(time).alias("_given"), order.cast("int").alias("_at"))
    return df.withColumnRenamed(time, "_given").join(times, [night, obs, "_given"]).withColumnRenamed("_at", out).drop("_given")


def with_halo(df: DataFrame, reach: int) -> DataFrame:
    """Rows in the chunks of their own and of all observations with an integration within `reach`.

    Adds chunk, home (whether it is the row's own) and at, the time from the chunk's first integration.
    """
    times = df.select("night", "obs", "time_idx").distinct()
    near = F.collect_set("obs").over(Window.partitionBy("night").orderBy("time_idx").rangeBetween(-reach, reach))
    to = times.withColumn("chunk", near).withColumn("chunk", F.explode("chunk"))
    to = to.withColumn("at", (F.col("time_idx") - F.min("time_idx").over(Window.partitionBy("night", "chunk"))).cast("int"))
    return df.join(to, ["night", "obs", "time_idx"]).withColumn("home", F.col("chunk") == F.col("obs"))


def detrend(df: DataFrame, by: Sequence[str], algorithm: str, kt: int = 8, kf: int = 8, value: str = "v", flag: str | None = None, out: str = "z") -> DataFrame:
    """A filter on the waterfalls (by) of each night, in chunks; equal to grouped.detrend on whole nights.

    Algorithms that need statistics of a whole waterfall have no reach and raise ValueError.
    """
    if algorithm not in kernels.ALGORITHMS:
        raise KeyError(algorithm)
    if algorithm not in REACH:
        raise ValueError(f"{algorithm} needs whole waterfalls")
    chunks = with_halo(df, REACH[algorithm](kt)).withColumnRenamed("time_idx", "_time").withColumnRenamed("at", "time_idx")
    z = grouped.detrend(chunks, ["night", "chunk", *by], algorithm, kt, kf, value, flag, out)
    return z.where("home").drop("time_idx", "chunk", "home").withColumnRenamed("_time", "time_idx")


def edge_times(flags: DataFrame, k: int) -> DataFrame:
    """flags with the first and last k integrations of each night flagged, where filters lack neighbours."""
    ends = flags.groupBy("night").agg(F.min("time_idx").alias("_lo"), F.max("time_idx").alias("_hi"))
    near = (F.col("time_idx") < F.col("_lo") + k) | (F.col("time_idx") > F.col("_hi") - k)
    return flags.join(ends, "night").withColumn("flag", F.col("flag") | near).drop("_lo", "_hi")

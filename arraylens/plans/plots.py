"""Tables that the usual diagnostic plots draw; no plotting library is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylens.operators.calibration import covariance


def delay_traces(fluct: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    return fluct.select(*by, "time_idx", "delay", "fluct")


def delay_zscores(fluct: DataFrame, overall: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    """(by, time_idx, z): fluctuations over the scatter of all, a heat map of antennas and times."""
    return fluct.crossJoin(F.broadcast(overall.select("agg_std"))).select(*by, "time_idx", F.try_divide("fluct", "agg_std").alias("z"))  # one row


def std_bars(ants: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    return ants.select(*by, "ant_std")


def gain_curves(cal: DataFrame, kind: str = "phase") -> DataFrame:
    """(ant, antpol, chan, value): time-averaged phases or amplitudes of gains."""
    x = F.atan2("gain_im", "gain_re") if kind == "phase" else F.hypot("gain_re", "gain_im")
    return cal.groupBy("ant", "antpol", "chan").agg(F.avg(x).alias("value"))


def chisq_curves(cal: DataFrame) -> DataFrame:
    """(ant, antpol, chan, chisq): medians over time."""
    return cal.groupBy("ant", "antpol", "chan").agg(F.median("chisq").alias("chisq"))


def baseline_matrix(vis: DataFrame, corr: bool = True) -> DataFrame:
    """(b1, b2, re, im, n): covariance or correlation of all listed baselines."""
    return covariance(vis, vis, corr=corr)


def baseline_scatter(vis: DataFrame, other: DataFrame) -> DataFrame:
    """(b1, b2, time_idx, chan, x, y): real parts of two baselines' shared pixels."""
    a = vis.select("time_idx", "chan", F.col("bl").alias("b1"), F.col("re").alias("x"))
    return a.join(other.select("time_idx", "chan", F.col("bl").alias("b2"), F.col("re").alias("y")), ["time_idx", "chan"])


def phase_curves(phase: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    """(by, chan, phase): medians over time of phase residuals."""
    return phase.groupBy(*by, "chan").agg(F.median("phase").alias("phase"))


def chisq_bars(chisq: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    """(by, chisq_avg, chisq_std, low, high, beyond): bars of one scatter about each antenna's chi-square; beyond marks scatters off the array's."""
    avg, std = F.col("chisq_avg"), F.col("chisq_std")
    return chisq.select(*by, "chisq_avg", "chisq_std", (avg - std).alias("low"), (avg + std).alias("high"), (F.abs("z") == F.col("max_z")).alias("beyond"))


def auto_view(autos: DataFrame) -> DataFrame:
    """(ant, pol, db): median power in decibels of each antenna's mean spectrum."""
    s = autos.groupBy("ant", "pol", "chan").agg(F.avg("v").alias("v")).groupBy("ant", "pol").agg(F.median("v").alias("v"))
    return s.select("ant", "pol", F.when(F.col("v") > 0, 10 * F.log10("v")).alias("db"))


def array_view(autos: DataFrame, ants: DataFrame, log: bool = True) -> DataFrame:
    """(ant, pol, x, y, receiver, connected, value, low, high): antennas where they stand, coloured by their median power.

    ants has (ant, x, y, receiver, connected); the scale runs from -30 to 15
    decibels, or from 0 to 12. Antennas without power have a NULL value.
    """
    level = auto_view(autos) if log else autos.groupBy("ant", "pol", "chan").agg(F.avg("v").alias("v")).groupBy("ant", "pol").agg(F.median("v").alias("db"))
    low, high = (-30.0, 15.0) if log else (0.0, 12.0)
    pols = autos.select("pol").distinct()
    grid = ants.select("ant", "x", "y", "receiver", "connected").crossJoin(F.broadcast(pols))  # the polarizations, four at most
    return grid.join(level, ["ant", "pol"], "left").select("ant", "pol", "x", "y", "receiver", "connected", F.col("db").alias("value"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def weak_antennas(view: DataFrame, share: float = 0.75) -> DataFrame:
    """(ant, pol, value) of connected antennas below `share` of the scale: those to look at."""
    return view.where(F.col("connected") & (F.col("value") < share * (F.col("high") - F.col("low")) + F.col("low"))).select("ant", "pol", "value")


def rms_histogram(autos: DataFrame, ants: DataFrame | None = None, block: int = 256, bins: int = 23, low: float = -2.0, high: float = 4.0) -> DataFrame:
    """(receiver, ant, pol, block, bin, left, n): histograms of the input's rms, sqrt(v / 2), in equal bins of its log2.

    A bin holds its left edge, the last one both; samples outside or not
    positive are left out. receiver comes from ants, NULL without it. A bin of
    log2 0 to 2 bits is where an input should be.
    """
    x = F.log2(F.sqrt(F.col("v") / 2))
    step = (high - low) / bins
    place = F.least(F.floor((x - low) / step), F.lit(bins - 1)).cast("int")
    inside = autos.where(F.col("v") > 0).withColumn("_x", x).where((F.col("_x") >= low) & (F.col("_x") <= high))
    out = inside.groupBy("ant", "pol", F.expr(f"CAST(chan div {int(block)} AS INT)").alias("block"), place.alias("bin")).agg(F.count("*").alias("n"))
    out = out.join(F.broadcast(ants.select("ant", "receiver")), "ant", "left") if ants is not None else out.withColumn("receiver", F.lit(None).cast("int"))  # rows of antennas
    return out.select("receiver", "ant", "pol", "block", "bin", (F.lit(low) + F.col("bin") * step).alias("left"), "n")

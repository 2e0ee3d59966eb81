"""Reductions: correlation statistics, spectra, z-scores and collapses.

Waterfalls are long tables with `time_idx`, `chan` and a value; `by` names the
columns that tell waterfalls apart. All reductions are native aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraylens.functions.expr import MAD_ARRAY, MAD_AUTO, MAD_SQUARE, c_abs, c_conj, c_mul, finite, ieee_divide, safe_divide

BASELINE = ["ant1", "ant2", "pol"]


# Correlation statistics


def _corr(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """|mean of p / |p|| over pixels with p = even * conj(odd) not 0; NULL without such pixels."""
    re, im = c_mul((F.col("even_re"), F.col("even_im")), c_conj((F.col("odd_re"), F.col("odd_im"))))
    p = pairs.select(*by, re.alias("re"), im.alias("im")).withColumn("size", c_abs("re", "im"))
    unit = [F.avg(F.when(F.col("size") > 0, F.col(c) / F.col("size"))) for c in ("re", "im")]
    return p.groupBy(*by).agg(F.hypot(*unit).alias("corr"))


def corr_stats_sumdiff(total: DataFrame, diff: DataFrame, by: Sequence[str] = BASELINE) -> DataFrame:
    """Correlation of even and odd samples, from their sums and differences on the same keys."""
    keys = [*by, "time_idx", "chan"]
    d = diff.select(*keys, F.col("re").alias("d_re"), F.col("im").alias("d_im"))
    both = total.join(d, keys)
    signs = {"even": 1, "odd": -1}
    parts = [(F.col(c) + s * F.col(f"d_{c}")).alias(f"{n}_{c}") for n, s in signs.items() for c in ("re", "im")]
    return _corr(both.select(*by, *parts), by)


def corr_stats_interleaved(vis: DataFrame, by: Sequence[str] = BASELINE) -> DataFrame:
    """The same from neighbouring integrations 2k and 2k + 1; an odd one out is dropped.

    Both halves of a pair meet in one aggregation, without a self-join.
    """
    keys = [*by, "chan", F.expr("time_idx div 2").alias("_pair")]
    odd = F.col("time_idx") % 2 == 1
    parts = [F.max(F.when(odd if n == "odd" else ~odd, F.col(c))).alias(f"{n}_{c}") for n in ("even", "odd") for c in ("re", "im")]
    return _corr(vis.groupBy(*keys).agg(*parts).where("even_re is not null and odd_re is not null"), by)


def corr_edges(corr: DataFrame) -> DataFrame:
    """Both directions of each baseline's correlation, without autos."""
    cross = corr.where("ant1 <> ant2").select("pol", "ant1", "ant2", "corr")
    return cross.unionByName(cross.select("pol", F.col("ant2").alias("ant1"), F.col("ant1").alias("ant2"), "corr")).distinct()


def corr_per_ant(edges: DataFrame, same: Sequence[str] = ("ee", "nn")) -> DataFrame:
    """Mean correlation of each antenna with the others, by same-feed polarization."""
    return edges.where(F.col("pol").isin(*same)).groupBy(F.col("ant1").alias("ant"), "pol").agg(F.avg("corr").alias("corr"))


def corr_cross_pol(edges: DataFrame, same: Sequence[str] = ("ee", "nn"), cross: Sequence[str] = ("en", "ne")) -> DataFrame:
    """Per antenna the largest mean excess of a same- over a cross-feed polarization."""
    s = edges.where(F.col("pol").isin(*same)).select("ant1", "ant2", F.col("pol").alias("sp"), F.col("corr").alias("s"))
    x = edges.where(F.col("pol").isin(*cross)).select("ant1", "ant2", F.col("pol").alias("xp"), F.col("corr").alias("x"))
    both = s.join(x, ["ant1", "ant2"]).groupBy("ant1", "sp", "xp").agg(F.avg(F.col("s") - F.col("x")).alias("m"))
    return both.groupBy(F.col("ant1").alias("ant")).agg(F.max("m").alias("corr_xpol"))


def dead_ants(edges: DataFrame, same: Sequence[str] = ("ee", "nn")) -> DataFrame:
    """Antennas whose median correlation is 0 or no number."""
    med = edges.where(F.col("pol").isin(*same)).groupBy(F.col("ant1").alias("ant"), "pol").agg(F.median(finite("corr")).alias("m"))
    return med.where("m is null or m = 0").select("ant", "pol")


# Reducers along time or channel


def nan_mad(df: DataFrame, by: Sequence[str], value: str = "v", out: str = "m") -> DataFrame:
    """Median absolute deviation from the median, by group."""
    med = df.groupBy(*by).agg(F.median(value).alias("_med"))
    return df.join(med, list(by)).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias(out))


def abs_diff(df: DataFrame, by: Sequence[str], value: str = "v", order: str = "time_idx") -> DataFrame:
    """Absolute first differences along an axis, between neighbouring indices only."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(order) - F.lag(order).over(w) == 1
    return df.withColumn("_d", F.when(step, F.abs(F.col(value) - F.lag(value).over(w))))


def reduce_axis(df: DataFrame, by: Sequence[str], how: str, value: str = "v", out: str = "s", order: str = "time_idx") -> DataFrame:
    """One of median, mean, mad, std, median_abs_diff and mean_abs_diff over what `by` leaves; NULLs are skipped."""
    plain = {"median": F.median, "mean": F.avg, "std": F.stddev_pop}
    if how in plain:
        return df.groupBy(*by).agg(plain[how](value).alias(out))
    if how == "mad":
        return nan_mad(df, by, value, out)
    if how in ("median_abs_diff", "mean_abs_diff"):
        d = abs_diff(df, by, value, order)
        return d.groupBy(*by).agg(plain[how.split("_")[0]]("_d").alias(out))
    raise ValueError(f"unknown reducer {how!r}")


def _over(df: DataFrame, by: Sequence[str], how: str, value: str, ex_ants: Sequence[int] = ()) -> Column:
    """Median or mean of the group's other rows and this one, antennas of ex_ants left out."""
    x = F.when(~F.col("ant").isin(*ex_ants), F.col(value)) if len(ex_ants) else F.col(value)
    return {"median": F.median, "mean": F.avg}[how](x).over(Window.partitionBy(*by))


def auto_spectra(
    autos: DataFrame, how: str = "median", scalar_norm: bool = True, waterfall_norm: bool = False, norm: str = "median", ex_ants: Sequence[int] = ()
) -> DataFrame:
    """(ant, pol, chan, s): time-reduced spectra of autos (ant, pol, time_idx, chan, v).

    waterfall_norm divides by the polarization's `norm` waterfall over antennas
    not in ex_ants; scalar_norm divides by the `norm` of the antenna's waterfall.
    """
    if waterfall_norm:
        ref = _over(autos, ["pol", "time_idx", "chan"], norm, "v", ex_ants)  # a group has a row for each antenna
        autos = autos.withColumn("v", safe_divide(F.col("v"), ref))
    out = reduce_axis(autos, ["ant", "pol", "chan"], how)
    if scalar_norm:
        out = out.join(reduce_axis(autos, ["ant", "pol"], norm, out="_n"), ["ant", "pol"])
        out = out.select("ant", "pol", "chan", safe_divide("s", "_n").alias("s"))
    return out


def spectrum_distance(
    spectra: DataFrame, ex_ants: Sequence[int] = (), overall: str = "median", metric: str = "median", power: float = 1.0, log: bool = False, abs_diff: bool = True
) -> DataFrame:
    """(ant, pol, d): each spectrum's reduced difference from its polarization's overall spectrum."""
    spectra = spectra.withColumn("_ref", _over(spectra, ["pol", "chan"], overall, "s", ex_ants))  # a group has a row for each antenna
    x = F.col("s") - F.col("_ref")
    if log:
        x = F.when(F.col("s") > 0, F.ln("s")) - F.when(F.col("_ref") > 0, F.ln("_ref"))
    if abs_diff:
        x = F.abs(x)
    if power != 1.0:
        x = F.pow(x, F.lit(power))
    both = spectra.select("ant", "pol", "chan", x.alias("x"))
    return reduce_axis(both, ["ant", "pol"], metric, "x", "d")


def modified_z(df: DataFrame, value: str = "d", out: str = "z", keep: Column | None = None, scale: float = MAD_AUTO) -> DataFrame:
    """df with (value - median) / MAD / scale, medians over all rows that `keep` holds for.

    df is a table of antennas, which the array bounds: one window over it reads it once.
    """
    w = Window.partitionBy(F.lit(0))
    kept = F.lit(True) if keep is None else keep
    x = df.withColumn("_med", F.median(F.when(kept, F.col(value))).over(w))
    x = x.withColumn("_mad", F.median(F.when(kept, F.abs(F.col(value) - F.col("_med")))).over(w))
    return x.withColumn(out, ieee_divide(F.col(value) - F.col("_med"), F.col("_mad")) / F.lit(scale)).drop("_med", "_mad")


def spectrum_modz(spectra: DataFrame, ex_ants: Sequence[int] = (), **how) -> DataFrame:
    """(ant, pol, d, z): modified z-scores of spectrum distances, pooled over polarizations; ex_ants take no part in the scale."""
    d = spectrum_distance(spectra, ex_ants, **how)
    return modified_z(d, keep=~F.col("ant").isin(*ex_ants) if len(ex_ants) else None)


#: The four autocorrelation metrics of each round: reducer, norms and distance.
AUTO_METRICS = {
    1: {
        "shape": (dict(how="median", scalar_norm=True), dict(abs_diff=True)),
        "temp_var": (dict(how="mad", waterfall_norm=True), dict(abs_diff=False)),
        "temp_diff": (dict(how="median_abs_diff", waterfall_norm=True), dict(abs_diff=False)),
        "power": (dict(how="median", scalar_norm=False), dict(abs_diff=True, log=True)),
    },
    2: {
        "shape": (dict(how="mean", norm="mean"), dict(overall="mean", metric="mean")),
        "temp_var": (dict(how="std", norm="mean", waterfall_norm=True), dict(overall="mean", metric="mean", abs_diff=False)),
        "temp_diff": (dict(how="mean_abs_diff", norm="mean", waterfall_norm=True), dict(overall="mean", metric="mean", abs_diff=False)),
        "power": (dict(how="mean", scalar_norm=False), dict(overall="mean", metric="mean", log=True)),
    },
}


# Whole waterfalls


def medmin(wf: DataFrame, by: Sequence[str] = (), value: str = "v") -> DataFrame:
    """2 * median - min of the channels' minima over time."""
    low = wf.groupBy(*by, "chan").agg(F.min(value).alias("_low"))
    return low.groupBy(*by).agg((2 * F.median("_low") - F.min("_low")).alias("medmin"))


def zscore_full(wf: DataFrame, by: Sequence[str] = (), value: str = "v", modified: bool = False, out: str = "z") -> DataFrame:
    """Whole-array z-scores, or modified ones; by group, over non-null samples."""
    by = list(by)

    def over(df: DataFrame, stat: DataFrame) -> DataFrame:
        return df.join(stat, by) if by else df.crossJoin(F.broadcast(stat))  # one row without groups

    if modified:
        wf = over(wf, wf.groupBy(*by).agg(F.median(value).alias("_c")))
        wf = over(wf, wf.groupBy(*by).agg((F.median(F.abs(F.col(value) - F.col("_c"))) * MAD_ARRAY).alias("_s")))
    else:
        wf = over(wf, wf.groupBy(*by).agg(F.avg(value).alias("_c"), F.stddev_pop(value).alias("_s")))
    return wf.withColumn(out, ieee_divide(F.col(value) - F.col("_c"), F.col("_s"))).drop("_c", "_s")


def modzscore_1d(series: DataFrame, by: Sequence[str] = (), value: str = "v", out: str = "z") -> DataFrame:
    """(x - median) / sqrt(median(d^2) / 0.456) over a whole series (no detrending)."""
    by = list(by)

    def over(df: DataFrame, stat: DataFrame) -> DataFrame:
        return df.join(stat, by) if by else df.crossJoin(F.broadcast(stat))

    s = over(series, series.groupBy(*by).agg(F.median(value).alias("_c")))
    s = over(s, s.groupBy(*by).agg(F.sqrt(F.median(F.pow(F.col(value) - F.col("_c"), F.lit(2))) / MAD_SQUARE).alias("_s")))
    return s.withColumn(out, ieee_divide(F.col(value) - F.col("_c"), F.col("_s"))).drop("_c", "_s")


def collapse(df: DataFrame, keys: Sequence[str], method: str = "quadmean", value: str = "v", weight: str | None = None, out: str = "v") -> DataFrame:
    """Weighted mean, absmean or quadmean of value by keys, NULL without weight; `w` has the summed weight.

    Metric products turn the NULL into infinity at their edge (`infinite`).
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    w = F.when(F.col(value).isNotNull(), w)
    x = {"mean": F.col(value), "absmean": F.abs(value), "quadmean": F.col(value) * F.col(value)}
    if method in ("and", "or"):
        f = F.bool_and if method == "and" else F.bool_or
        return df.groupBy(*keys).agg(f(value).alias(out))
    if method not in x:
        raise ValueError(f"unknown method {method!r}")
    mean = safe_divide(F.sum(x[method] * w), F.sum(w))
    return df.groupBy(*keys).agg((F.sqrt(mean) if method == "quadmean" else mean).alias(out), F.sum(w).alias("w"))


def infinite(df: DataFrame, *values: str) -> DataFrame:
    """NULL metrics as infinity, as products hold them."""
    return df.withColumns({v: F.coalesce(F.col(v), F.lit(float("inf"))) for v in values})


def combine_metrics(metrics: Sequence[DataFrame], keys: Sequence[str] = ("time_idx", "chan"), method: str = "quadmean") -> DataFrame:
    """Weighted combination of products (keys, v, w) into one."""
    every = metrics[0]
    for m in metrics[1:]:
        every = every.unionByName(m)
    return collapse(every, keys, method, weight="w")


def fill_infinite(second: DataFrame, first: DataFrame, keys: Sequence[str] = ("time_idx", "chan"), value: str = "v") -> DataFrame:
    """second with its infinite values taken from first."""
    f = first.select(*keys, F.col(value).alias("_first"))
    bad = F.abs(F.col(value)) == F.lit(float("inf"))
    return second.join(f, list(keys), "left").withColumn(value, F.when(bad, F.col("_first")).otherwise(F.col(value))).drop("_first")

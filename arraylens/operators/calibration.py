"""Calibration metrics: delays, chi-square and gain phases, with biweight statistics."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraylens.functions.expr import c_arg, c_div, ieee_divide, safe_divide


def biweight(df: DataFrame, by: Sequence[str], value: str = "v", location: str = "loc", midvar: str = "midvar") -> DataFrame:
    """Biweight location (c = 6) and midvariance (c = 9) by group, NULLs skipped; a MAD of 0 gives the median and 0.

    Three aggregations: median, MAD, weighted sums.
    """
    by = list(by)

    def over(a: DataFrame, stat: DataFrame) -> DataFrame:
        return a.join(stat, by) if by else a.crossJoin(F.broadcast(stat))  # one row without groups

    x = over(df, df.groupBy(*by).agg(F.median(value).alias("_m")))
    x = over(x, x.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_mad")))
    return _weighted(x, by, value, location, midvar)


def _sums(value: str) -> dict[str, Column]:
    """The weighted sums of biweight, for rows with their group's median _m and deviation _mad."""
    d = F.col(value) - F.col("_m")
    u6, u9 = (F.pow(safe_divide(d, c * F.col("_mad")), F.lit(2)) for c in (6.0, 9.0))
    w = F.when(u6 < 1, F.pow(1 - u6, F.lit(2)))
    top = F.when(u9 < 1, d * d * F.pow(1 - u9, F.lit(4)))
    low = F.when(u9 < 1, (1 - u9) * (1 - 5 * u9))
    return {"_n": F.count(value), "_a": F.sum(d * w), "_b": F.sum(w), "_t": F.sum(top), "_l": F.sum(low)}


def _midvar() -> Column:
    return F.coalesce(safe_divide(F.col("_n") * F.col("_t"), F.col("_l") * F.col("_l")), F.lit(0.0))


def _weighted(x: DataFrame, by: Sequence[str], value: str, location: str, midvar: str, **more: Column) -> DataFrame:
    """(by, location, midvar, more) of rows with their group's median _m and deviation _mad; more are other aggregates."""
    s = x.groupBy(*by).agg(F.first("_m").alias("_m"), *[c.alias(k) for k, c in (_sums(value) | more).items()])
    loc = F.col("_m") + F.coalesce(safe_divide("_a", "_b"), F.lit(0.0))
    return s.select(*by, loc.alias(location), _midvar().alias(midvar), *more)


def dealt_median(df: DataFrame, by: Sequence[str] = (), value: str = "v", out: str = "median", keep: Sequence[str] = ()) -> DataFrame:
    """(by, out, keep): exact medians of large groups, NULLs skipped; keep names columns that are constant in a group.

    No task holds a group: a sketch in parts bounds the middle from both sides,
    values outside and at the bounds are only counted, and the few between them
    are sorted. The bounds stand ten times as far from the middle as the sketch
    can err; if they missed it, the query would fail.
    """
    by, v, n = list(by), F.col(value), F.col("_n")
    low, high = F.col("_near")[0], F.col("_near")[1]
    near = df.groupBy(*by).agg(F.count(value).alias("_n"), F.percentile_approx(value, [0.499, 0.501], 10000).alias("_near"))
    sides = {"_below": v < low, "_low": v <= low, "_inside": (v > low) & (v < high), "_upto": v <= high}
    inside = F.sort_array(F.collect_list(F.when(sides["_inside"], v))).alias("_between")
    x = _all_of(df.select(*by, value, *keep), near, by).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("_n", "_near", *keep)], *[F.count_if(sides[c]).alias(c) for c in ("_below", "_low", "_upto")], inside
    )

    def at(k: Column) -> Column:
        between = F.get("_between", (k - F.col("_low")).cast("int"))
        found = F.when(k < F.col("_low"), low).when(k < F.col("_low") + F.size("_between"), between).otherwise(high)
        missed = F.raise_error(F.lit("the middle of a group is outside its bounds")).cast("double")
        return F.when((k >= F.col("_below")) & (k < F.col("_upto")), found).otherwise(missed)

    lower, upper = F.floor((n - 1) / 2), F.floor(n / 2)
    middle = F.when(n == 0, F.lit(None)).when(lower == upper, at(lower)).otherwise(at(lower) * 0.5 + at(upper) * 0.5)
    return x.select(*by, middle.cast("double").alias(out), *keep)


def dealt_biweight(df: DataFrame, by: Sequence[str] = (), value: str = "v", location: str = "loc", midvar: str = "midvar") -> DataFrame:
    """biweight of large groups, by dealt medians."""
    m = dealt_median(df, by, value, "_m")
    mad = dealt_median(_all_of(df, m, by).withColumn("_d", F.abs(F.col(value) - F.col("_m"))), by, "_d", "_mad", ["_m"])
    return _weighted(_all_of(df, mad, by), by, value, location, midvar)


def unwrap(df: DataFrame, by: Sequence[str], phase: str = "phase", order: str = "chan", out: str = "phase") -> DataFrame:
    """Phases along an axis without jumps of more than pi."""
    w = Window.partitionBy(*by).orderBy(order)
    d = F.col(phase) - F.lag(phase).over(w)
    turn = F.coalesce(-2 * pi * F.round(d / (2 * pi)), F.lit(0.0))
    x = df.withColumn("_t", turn)
    return x.withColumn(out, F.col(phase) + F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def fit_delays(gains: DataFrame, by: Sequence[str] = ("ant", "antpol", "time_idx"), re: str = "gain_re", im: str = "gain_im") -> DataFrame:
    """(by, delay_s, offset, rotated): delay of the median phase slope, phase at 0 Hz and whether it is about pi.

    Gains are dealt by spectra into as many tasks as there are shuffle partitions:
    a count, as what their sorts hold is several times what is dealt.
    """
    by = list(by)
    parts = int(gains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = unwrap(gains.select(*by, "chan", "freq_hz", c_arg(re, im).alias("phase")).repartition(parts, *by), by)
    w = Window.partitionBy(*by).orderBy("chan")
    slope = safe_divide(F.col("phase") - F.lag("phase").over(w), F.col("freq_hz") - F.lag("freq_hz").over(w))
    p = p.withColumn("_s", slope)
    first = F.min_by(F.struct("phase", "freq_hz"), "chan")
    out = p.groupBy(*by).agg(F.median("_s").alias("_s"), first.alias("_f"))
    offset = F.col("_f.phase") - F.col("_s") * F.col("_f.freq_hz")
    out = out.select(*by, (F.col("_s") / F.lit(-2 * pi)).alias("delay_s"), offset.alias("offset"))
    return out.withColumn("rotated", F.abs(F.pmod(F.abs("offset"), F.lit(2 * pi)) - F.lit(pi)) < 0.1)


def delay_fluctuations(delays: DataFrame, by: Sequence[str] = ("ant", "antpol"), value: str = "delay", flag: str | None = None) -> DataFrame:
    """delays with `avg`, the antenna's median, `fluct`, the distance from it, and `ok`; flagged ones count as 0 and have no part in the median."""
    by = list(by)
    x = delays.withColumn("ok", F.lit(True) if flag is None else ~F.col(flag))
    med = x.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("ok"), F.col(value))), F.lit(0.0)).alias("avg"))
    return x.join(med, by).withColumn("fluct", F.when(F.col("ok"), F.coalesce(F.col(value), F.lit(0.0))).otherwise(0.0) - F.col("avg"))


def _all_of(df: DataFrame, stat: DataFrame, each: Sequence[str]) -> DataFrame:
    return df.join(stat, list(each)) if each else df.crossJoin(F.broadcast(stat))  # one row without groups


def delay_scatter(fluct: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    """(by, ant_avg, ant_std): the antenna's median delay and the scatter of its unflagged fluctuations; see delay_std."""
    by = list(by)
    good = fluct.withColumn("fluct", F.when(F.col("ok"), F.col("fluct")))
    out = biweight(good, by, "fluct").join(fluct.groupBy(*by).agg(F.first("avg").alias("ant_avg")), by)
    return out.select(*by, "ant_avg", F.sqrt("midvar").alias("ant_std"))


def _antenna_std(fluct: DataFrame, by: Sequence[str], each: Sequence[str]) -> DataFrame:
    """(by, ant_avg, ant_std, ant_z, agg_std): an antenna's scatter and the whole's beside it; the array bounds tables of antennas."""
    by, v, m = list(by), F.col("_v"), F.col("_m")
    x = fluct.withColumn("_v", F.when(F.col("ok"), F.col("fluct")))
    whole = dealt_biweight(x, each, "_v").select(*each, F.sqrt("midvar").alias("agg_std"))
    med = x.groupBy(*by).agg(F.median("_v").alias("_m"))
    mad = x.join(F.broadcast(med), by).groupBy(*by).agg(F.median(F.abs(v - m)).alias("_mad"), F.first("_m").alias("_m"))
    size = F.median(F.abs(ieee_divide("fluct", "agg_std")))
    out = _weighted(_all_of(x.join(F.broadcast(mad), by), whole, each), by, "_v", "loc", "midvar", ant_avg=F.first("avg"), ant_z=size, agg_std=F.first("agg_std"))
    return out.select(*by, "ant_avg", F.sqrt("midvar").alias("ant_std"), "ant_z", "agg_std")


def delay_std(fluct: DataFrame, by: Sequence[str] = ("ant", "antpol"), each: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per antenna, per time, whole): scatter of delay fluctuations, square roots of biweight midvariances of the unflagged ones, 0 without any.

    ant_avg is the antenna's median delay, ant_z the median size of all its fluctuations over the whole scatter.
    What `each` names, such as obs, is a whole of its own in all three tables.
    """
    each = list(each)
    by = [*each, *(b for b in by if b not in each)]
    ant = _antenna_std(fluct, by, each)
    agg = ant.groupBy(*each).agg(F.coalesce(F.first("agg_std"), F.lit(0.0)).alias("agg_std"), F.max("ant_std").alias("max_std"))
    good = fluct.withColumn("fluct", F.when(F.col("ok"), F.col("fluct")))
    time = biweight(good, [*each, "time_idx"], "fluct").select(*each, "time_idx", F.sqrt("midvar").alias("time_std"))
    return ant.drop("agg_std"), time, agg


def delay_zscores(fluct: DataFrame, by: Sequence[str] = ("ant", "antpol"), each: Sequence[str] = ()) -> DataFrame:
    """(by, time_idx, ant_avg, ant_std, time_std, agg_std, max_std, z, ant_z): all of delay_std, a row for each antenna and integration.

    z is the fluctuation over the whole scatter, with the infinities and NaN of a scatter of 0.
    A task holds the antennas of an integration.
    """
    each = list(each)
    by = [*each, *(b for b in by if b not in each)]
    ant = _antenna_std(fluct, by, each).withColumn("max_std", F.max("ant_std").over(Window.partitionBy(*each)))  # a row an antenna
    w = Window.partitionBy(*each, "time_idx")
    x = fluct.select(*by, "time_idx", "fluct", F.when(F.col("ok"), F.col("fluct")).alias("_v")).withColumn("_m", F.median("_v").over(w))
    x = x.withColumn("_mad", F.median(F.abs(F.col("_v") - F.col("_m"))).over(w))
    x = x.withColumns({k: c.over(w) for k, c in _sums("_v").items()}).withColumn("time_std", F.sqrt(_midvar()))
    z = ieee_divide("fluct", "agg_std").alias("z")
    return x.join(F.broadcast(ant), by).select(*by, "time_idx", "ant_avg", "ant_std", "time_std", "agg_std", "max_std", z, "ant_z")


def in_band(cal: DataFrame, edge: int = 0, channels: int | None = None) -> DataFrame:
    """The channels between the edges."""
    band = cal.where(F.col("chan") >= edge)
    return band if channels is None else band.where(F.col("chan") < channels - edge)


def chisq_metric(
    cal: DataFrame, by: Sequence[str] = ("ant", "antpol"), cut: float = 4.0, edge: int = 0, channels: int | None = None, each: Sequence[str] = ()
) -> DataFrame:
    """(by, chisq_avg, chisq_std, z, std_loc, std_scale, max_z, tot_avg, good): biweights of chi-square over all times and channels of the band.

    z is an antenna's scatter against that of all, max_z its largest size, tot_avg the location over all antennas.
    What `each` names, such as obs, is an array of its own.
    """
    each = list(each)
    by = [*each, *(b for b in by if b not in each)]
    band = in_band(cal, edge, channels)
    ant = biweight(band, by, "chisq").select(*by, F.col("loc").alias("chisq_avg"), F.sqrt("midvar").alias("chisq_std"))
    over = biweight(ant, each, "chisq_std").select(*each, F.col("loc").alias("std_loc"), F.sqrt("midvar").alias("std_scale"))
    total = biweight(band, each, "chisq").select(*each, F.col("loc").alias("tot_avg"))
    out = _all_of(_all_of(ant, over, each), total, each)
    out = out.withColumn("z", ieee_divide(F.col("chisq_std") - F.col("std_loc"), "std_scale"))
    worst = out.groupBy(*each).agg(F.max(F.abs("z")).alias("max_z")).withColumn("good", F.col("max_z") < cut)
    return _all_of(out, worst, each)


def chisq_over_time(cal: DataFrame, edge: int = 0, channels: int | None = None, each: Sequence[str] = ()) -> DataFrame:
    """(each, time_idx, chisq_avg): median over the band of the medians over antennas."""
    per = in_band(cal, edge, channels).groupBy(*each, "time_idx", "chan").agg(F.median("chisq").alias("_m"))
    return per.groupBy(*each, "time_idx").agg(F.median("_m").alias("chisq_avg"))


def gain_ratio(omni: DataFrame, first: DataFrame, keys: Sequence[str] = ("ant", "antpol", "time_idx", "chan")) -> DataFrame:
    """(keys, re, im): omnical over firstcal gains."""
    f = first.select(*keys, F.col("gain_re").alias("_r"), F.col("gain_im").alias("_i"))
    re, im = c_div((F.col("gain_re"), F.col("gain_im")), (F.col("_r"), F.col("_i")))
    return omni.join(f, list(keys)).select(*keys, re.alias("re"), im.alias("im"))


def phase_residuals(ratio: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    """(by, time_idx, chan, phase): gain phases without the median of their antenna and time."""
    keys = [*by, "time_idx"]
    p = ratio.select(*keys, "chan", c_arg("re", "im").alias("phase"))
    return p.join(p.groupBy(*keys).agg(F.median("phase").alias("_m")), keys).select(*keys, "chan", (F.col("phase") - F.col("_m")).alias("phase"))


def phase_std(phases: DataFrame, edge: int = 0, channels: int | None = None, by: Sequence[str] = ("ant", "antpol")) -> tuple[DataFrame, DataFrame]:
    """(per antenna, per antenna and time): biweight scatter of phases over the band between the edges."""
    band = in_band(phases, edge, channels)
    per = biweight(band, [*by], "phase").select(*by, F.sqrt("midvar").alias("phs_std"))
    time = biweight(band, [*by, "time_idx"], "phase").select(*by, "time_idx", F.sqrt("midvar").alias("phs_std"))
    return per, time


def phase_histogram(phases: DataFrame, by: Sequence[str] = ("ant", "antpol"), bins: int = 128) -> DataFrame:
    """(by, bin, density): densities of phases in equal bins from -pi to pi, the last one closed."""
    width = 2 * pi / bins
    b = F.least(F.floor((F.col("phase") + pi) / width), F.lit(bins - 1)).cast("int")
    inside = phases.where(F.abs("phase") <= pi).select(*by, b.alias("bin"))
    n = inside.groupBy(*by, "bin").agg(F.count("*").alias("_n"))
    total = n.groupBy(*by).agg(F.sum("_n").alias("_t"))
    return n.join(total, list(by)).select(*by, "bin", (F.col("_n") / F.col("_t") / F.lit(width)).alias("density"))


def covariance(vis: DataFrame, other: DataFrame, by: Sequence[str] = (), corr: bool = False) -> DataFrame:
    """(b1, b2, by, re, im, n): weighted complex covariance of baselines over shared pixels; with corr, the correlation.

    vis and other have a column `bl`; flagged or null pixels of either side do
    not count. One pass of sums, no second look at the samples.
    """
    keys = ["time_idx", "chan"]

    def side(d: DataFrame, n: str) -> DataFrame:
        ok = d.where(~F.col("flag")) if "flag" in d.columns else d
        return ok.where("re is not null and im is not null").select(*keys, F.col("bl").alias(f"b{n}"), F.col("re").alias(f"r{n}"), F.col("im").alias(f"i{n}"))

    p = side(vis, "1").join(side(other, "2"), keys)
    c = {f"s{x}": F.sum(x) for x in ("r1", "i1", "r2", "i2")}
    re = F.col("r1") * F.col("r2") + F.col("i1") * F.col("i2")
    im = F.col("i1") * F.col("r2") - F.col("r1") * F.col("i2")
    size = {f"q{n}": F.sum(F.pow(f"r{n}", F.lit(2)) + F.pow(f"i{n}", F.lit(2))) for n in "12"}
    s = p.groupBy("b1", "b2", *by).agg(F.count("*").alias("n"), F.sum(re).alias("_re"), F.sum(im).alias("_im"), *[v.alias(k) for k, v in (c | size).items()])
    n = F.col("n")
    out_re = F.col("_re") / n - (F.col("sr1") * F.col("sr2") + F.col("si1") * F.col("si2")) / (n * n)
    out_im = F.col("_im") / n - (F.col("si1") * F.col("sr2") - F.col("sr1") * F.col("si2")) / (n * n)
    if corr:
        v1, v2 = (F.col(f"q{k}") / n - (F.pow(f"sr{k}", F.lit(2)) + F.pow(f"si{k}", F.lit(2))) / (n * n) for k in "12")
        low = F.greatest(F.sqrt(v1 * v2), F.lit(1e-10))
        out_re, out_im = out_re / low, out_im / low
    return s.select("b1", "b2", *by, out_re.alias("re"), out_im.alias("im"), "n")

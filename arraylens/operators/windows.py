"""Ordered-window operators, native: derivatives, differences, box filters and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraylens.functions.expr import above, finite, safe_divide, upper_median


def mirrored(df: DataFrame, axis: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """df with k more indices beyond each end of `axis`, the edge sample repeated first.

    Indices run from 0; `_size` has the length of the axis. Filters window over
    the mirrored rows and then keep 0 <= index < _size.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))  # one waterfall, as in the filters
    i, size = F.col(axis), F.col("_size")
    df = df.withColumn("_size", F.max(axis).over(group) + 1)
    images = F.array(i, F.when(i < k, -1 - i), F.when(i >= size - k, 2 * size - 1 - i))
    return df.withColumn(axis, F.explode(F.array_compact(images).cast("array<int>")))


def gradient(df: DataFrame, axis: str, by: Sequence[str], value: str = "v", out: str = "g") -> DataFrame:
    """Central differences along an axis without gaps, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(axis)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)
    return df.withColumn(out, g)


def detrend_deriv(wf: DataFrame, by: Sequence[str] = (), dt: bool = True, df: bool = True, value: str = "v", out: str = "z") -> DataFrame:
    """Derivatives in frequency and time over a separable scale.

    The scale is sqrt(sf * st / median(st)) with sf and st the medians over time
    and channel of the squared derivatives.
    """
    by = list(by)
    x = wf.withColumn("_g", F.col(value))
    if df:
        x = gradient(x, "chan", [*by, "time_idx"], "_g", "_g")
    if dt:
        x = gradient(x, "time_idx", [*by, "chan"], "_g", "_g")
    square = F.pow("_g", F.lit(2))
    x = x.withColumns({"_sf": F.median(square).over(Window.partitionBy(*by, "chan")), "_st": F.median(square).over(Window.partitionBy(*by, "time_idx"))})
    # times have equally many channels, so that the median over rows is that over times
    x = x.withColumn("_mid", F.median("_st").over(Window.partitionBy(*(by or [F.lit(0)]))))
    scale = F.sqrt(F.col("_sf") * safe_divide("_st", "_mid"))
    return x.withColumn(out, safe_divide("_g", scale)).drop("_g", "_sf", "_st", "_mid")


def sequential_diff(df: DataFrame, axis: str, by: Sequence[str], values: Sequence[str] = ("re", "im"), pad: bool = True) -> DataFrame:
    """x[i + 1] - x[i] along an axis, over sqrt(2) as both ends have equal integration times.

    With pad the last sample becomes 0 - x with weight 0, else it is dropped.
    """
    w = Window.partitionBy(*by).orderBy(axis)
    last = F.lead(axis).over(w).isNull()
    out = df.withColumn("_last", last).withColumns(
        {v: (F.coalesce(F.lead(v).over(w), F.lit(0.0)) - F.col(v)) * F.when(last, 1.0).otherwise(F.lit(0.5**0.5)) for v in values}
    )
    weight = F.when(F.col("_last"), 0.0).otherwise(F.col("weight") if "weight" in df.columns else F.lit(1.0))
    out = out.withColumn("weight", weight)
    return (out if pad else out.where(~F.col("_last"))).drop("_last")




def medmin_filter(wf: DataFrame, by: Sequence[str] = (), kt: int = 8, kf: int = 8, value: str = "v", out: str = "f") -> DataFrame:
    """medmin of the half-open box [i - kt, i + kt) x [j - kf, j + kf) around each pixel, cut at the edges."""
    by = list(by)
    t = Window.partitionBy(*by, "chan").orderBy("time_idx").rangeBetween(-kt, kt - 1)
    f = Window.partitionBy(*by, "time_idx").orderBy("chan").rangeBetween(-kf, kf - 1)
    low = wf.withColumn("_low", F.min(value).over(t)).withColumn("_lows", F.sort_array(F.collect_list("_low").over(f)))
    n = F.size("_lows")
    half = (n / 2).cast("int")
    median = F.when(n % 2 == 1, F.element_at("_lows", half + 1)).otherwise((F.element_at("_lows", F.greatest(half, F.lit(1))) + F.element_at("_lows", half + 1)) / 2)
    return low.withColumn(out, 2 * median - F.element_at("_lows", 1)).drop("_low", "_lows")


def detrend_medmin_filter(wf: DataFrame, by: Sequence[str] = (), kt: int = 8, kf: int = 8, value: str = "v", out: str = "z") -> DataFrame:
    """(d - medmin filter of |d|) / (sqrt(medmin filter of d^2) * sqrt(kt^2 + kf^2) / 0.64), boxes of 2k + 1."""
    x = wf.withColumn("_a", F.abs(value))
    x = medmin_filter(x, by, 2 * kt + 1, 2 * kf + 1, "_a", "_m").withColumn("_d", F.col(value) - F.col("_m"))
    x = medmin_filter(x.withColumn("_q", F.col("_d") * F.col("_d")), by, 2 * kt + 1, 2 * kf + 1, "_q", "_s")
    scale = F.sqrt(F.col("_s")) * F.lit((kt**2 + kf**2) ** 0.5 / 0.64)
    return x.withColumn(out, safe_divide("_d", scale)).drop("_a", "_m", "_d", "_q", "_s")


def box_mean(wf: DataFrame, by: Sequence[str], kt: int, kf: int, value: str, weight: str, out: str) -> DataFrame:
    """Weighted means over (2kt + 1) x (2kf + 1) boxes, by sums along channels, then along time."""
    f = Window.partitionBy(*by, "time_idx").orderBy("chan").rangeBetween(-kf, kf)
    t = Window.partitionBy(*by, "chan").orderBy("time_idx").rangeBetween(-kt, kt)
    x = wf.withColumns({"_bs": F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight)).over(f), "_bw": F.sum(weight).over(f)})
    x = x.withColumns({"_bs": F.sum("_bs").over(t), "_bw": F.sum("_bw").over(t)})
    return x.withColumn(out, safe_divide("_bs", "_bw")).drop("_bs", "_bw")


def detrend_mean_filter(wf: DataFrame, by: Sequence[str] = (), kt: int = 8, kf: int = 8, value: str = "v", flag: str | None = None, out: str = "z") -> DataFrame:
    """(d - box mean) / sqrt(box mean of the squared residual) on mirrored edges; null and flagged samples weigh 0."""
    by = list(by)
    good = F.col(value).isNotNull() & (F.lit(True) if flag is None else ~F.col(flag))
    x = wf.withColumn("_ok", good.cast("double"))
    x = mirrored(mirrored(x, "time_idx", kt, by).withColumnRenamed("_size", "_nt"), "chan", kf, by).withColumnRenamed("_size", "_nf")
    x = box_mean(x, by, kt, kf, value, "_ok", "_m").withColumn("_d", F.col(value) - F.col("_m"))
    x = box_mean(x.withColumn("_q", F.col("_d") * F.col("_d")), by, kt, kf, "_q", "_ok", "_s")
    x = x.where("time_idx >= 0 and time_idx < _nt and chan >= 0 and chan < _nf")
    return x.withColumn(out, safe_divide("_d", F.sqrt("_s"))).drop("_ok", "_m", "_d", "_q", "_s", "_nt", "_nf")


def channel_diff_flags(
    wf: DataFrame, by: Sequence[str] = (), nsig: float = 6.0, widths: Sequence[int] = (3, 4, 5), value: str = "v", noise: str = "noise", out: str = "flag"
) -> DataFrame:
    """Flags samples more than nsig noises above the mean of their neighbours in frequency.

    For each width, the model is the mean of the unflagged samples within that
    many channels, the sample itself left out, on mirrored edges; a sample is
    flagged where value - model > nsig * |model| * noise / value. Flags of a
    width weigh 0 in the next one.
    """
    by = list(by)
    x = wf.withColumn(out, F.lit(False))
    for k in widths:
        w = x.withColumn("_w", F.when(F.col(out) | F.col(value).isNull(), 0.0).otherwise(1.0))
        m = mirrored(w, "chan", k, [*by, "time_idx"])
        order = Window.partitionBy(*by, "time_idx").orderBy("chan")

        def around(c: Column, order=order, k=k) -> Column:
            left, right = (F.coalesce(F.sum(c).over(order.rangeBetween(*r)), F.lit(0.0)) for r in ((-k, -1), (1, k)))
            return left + right

        model = safe_divide(around(F.coalesce(value, F.lit(0.0)) * F.col("_w")), around(F.col("_w")))
        m = m.withColumn("_m", model).where("chan >= 0 and chan < _size")
        level = safe_divide(F.lit(float(nsig)) * F.abs("_m") * F.col(noise), F.col(value))
        x = m.withColumn(out, above(F.col(value) - F.col("_m") - level, 0.0)).drop("_w", "_m", "_size")
    return x


def true_stretches(flags: DataFrame, by: Sequence[str] = (), order: str = "idx", flag: str = "flag") -> DataFrame:
    """(by, start, stop): runs of neighbouring true flags, stop exclusive."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    on = flags.where(flag)
    return on.withColumn("_run", F.col(order) - F.row_number().over(w)).groupBy(*by, "_run").agg(
        F.min(order).alias("start"), (F.max(order) + 1).alias("stop")
    ).drop("_run")


def rank_filter_1d(df: DataFrame, axis: str, by: Sequence[str], k: int, value: str, out: str, centre: bool = True) -> DataFrame:
    """Upper median of 2k + 1 samples along an axis on mirrored edges; without the sample itself if centre is False."""
    w = Window.partitionBy(*by).orderBy(axis)
    m = mirrored(df, axis, k, by)
    if centre:
        got = F.collect_list(value).over(w.rangeBetween(-k, k))
    else:
        got = F.concat(F.collect_list(value).over(w.rangeBetween(-k, -1)), F.collect_list(value).over(w.rangeBetween(1, k)))
    return m.withColumn(out, upper_median(got)).where(f"{axis} >= 0 and {axis} < _size").drop("_size")


def modzscore_detrended(series: DataFrame, axis: str, by: Sequence[str] = (), k: int = 8, value: str = "v", out: str = "z") -> DataFrame:
    """Modified z of a series about its running median, the sample itself left out, over the running scale."""
    by = list(by)
    x = rank_filter_1d(series, axis, by, k, value, "_m", centre=False).withColumn("_d", F.col(value) - F.col("_m"))
    x = rank_filter_1d(x.withColumn("_q", F.col("_d") * F.col("_d")), axis, by, k, "_q", "_s", centre=False)
    return x.withColumn(out, safe_divide("_d", F.sqrt(F.col("_s") / 0.456))).drop("_m", "_d", "_q", "_s")


def difference_variance(x: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, chan, _v): mean over time of double differences (_re, _im), squared, over 4 times the product of _auto1 and _auto2; missing ones don't count."""
    x = x.where("_re is not null and _auto1 is not null and _auto2 is not null")
    n = safe_divide(F.pow("_re", F.lit(2)) + F.pow("_im", F.lit(2)), 4 * (F.col("_auto1") * F.col("_auto2")))
    return x.withColumn("_n", n).groupBy(*by, "chan").agg(F.avg("_n").alias("_v"))


def noise_variance(vis: DataFrame, by: Sequence[str] = ("ant1", "ant2", "pol")) -> DataFrame:
    """(by, chan, variance): variance over time of 2 x 2 double differences over the product of the averaged autos.

    vis has re, im, auto1 and auto2 (the autos of both antennas), chan_width and
    int_time; a variance is scaled by mean channel width and integration time and
    equals 1 for ideal radiometer noise.
    """
    by = list(by)
    f = Window.partitionBy(*by, "time_idx").orderBy("chan")
    t = Window.partitionBy(*by, "chan").orderBy("time_idx")

    def diff(c: str) -> Column:
        return F.col(c) - F.lead(c).over(f)

    x = vis.withColumns({"_re": diff("re"), "_im": diff("im")} | {f"_{c}": F.col(c) + F.lead(c).over(f) for c in ("auto1", "auto2")})
    x = x.withColumns({c: F.col(c) - F.lead(c).over(t) for c in ("_re", "_im")} | {c: (F.col(c) + F.lead(c).over(t)) / 4 for c in ("_auto1", "_auto2")})
    scale = vis.agg(F.avg("chan_width").alias("_cw"), F.avg("int_time").alias("_it"))
    out = difference_variance(x, by).crossJoin(F.broadcast(scale))  # one row
    return out.select(*by, "chan", (F.col("_v") * F.col("_cw") * F.col("_it")).alias("variance"))


def finite_or_null(df: DataFrame, *values: str) -> DataFrame:
    return df.withColumns({v: finite(v) for v in values})

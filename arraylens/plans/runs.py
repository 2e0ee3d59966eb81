"""Whole runs: antenna metrics, auto metrics, interference flagging and calibration metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylens.functions.expr import INF, at_least
from arraylens.operators import calibration, flags, grouped, iterate, reduce


def ant_metrics(
    total: DataFrame, diff: DataFrame | None = None, cross_cut: float = 0.0, dead_cut: float = 0.4
) -> tuple[DataFrame, DataFrame]:
    """(excluded, metrics) of the search for dead and crossed antennas in visibilities."""
    corr = reduce.corr_stats_interleaved(total) if diff is None else reduce.corr_stats_sumdiff(total, diff)
    return iterate.antenna_search(reduce.corr_edges(corr), cross_cut, dead_cut)


def auto_metrics(autos: DataFrame, cuts: tuple[float, float] = (8.0, 4.0), edge_cut: int = 100, prior: Sequence[int] = (), **rfi) -> dict[str, object]:
    """Antennas excluded by the two rounds, the flags between them and the scores of the last pass.

    Round 2 leaves out the pixels that the mean waterfall of the kept antennas flags.
    """
    inner = flags.edge_mask(autos, edge_cut).where("NOT edge").drop("edge")
    first = sorted(set(prior))
    while (after := iterate.auto_pass(inner, 1, first, cuts[0])[0]) != set(first):
        first = sorted(after)
    mean = reduce.collapse(autos.where(~F.col("ant").isin(*first)) if first else autos, ["time_idx", "chan"], "mean").select("time_idx", "chan", "v")
    mask = grouped.simple_flags(mean, [], edge_cut=edge_cut, **rfi).select("time_idx", "chan", "flag")
    clean = autos.join(mask, ["time_idx", "chan"]).where("NOT flag").drop("flag")
    ex = list(first)
    while True:
        after, scores = iterate.auto_pass(clean, 2, ex, cuts[1])
        if after == set(ex):
            return {"round1": first, "round2": sorted(ex), "flags": mask, "scores": scores}
        ex = sorted(after)


def metric_pipe(
    data: DataFrame, by: Sequence[str], algorithm: str = "detrend_medfilt", kt: int = 8, kf: int = 8, value: str = "v", centre: bool = True, method: str = "quadmean"
) -> DataFrame:
    """(time_idx, chan, v, w): an algorithm on each waterfall, collapsed over waterfalls, and filtered again (centred).

    w is 1 where there are data and else 0, so that all products count alike when they are combined.
    """
    z = grouped.detrend(data, by, algorithm, kt, kf, value)
    z = z.withColumn("z", F.when(F.abs("z") < INF, F.col("z")))
    wf = reduce.collapse(z, ["time_idx", "chan"], method, "z").withColumn("w", F.when(F.col("w") > 0, 1.0).otherwise(0.0))
    if not centre:
        return reduce.infinite(wf, "v")
    again = grouped.detrend(wf, [], algorithm, kt, kf, "v", out="z")
    return reduce.infinite(again.select("time_idx", "chan", F.when(F.abs("z") < INF, F.col("z")).alias("v"), "w"), "v")


def chi_square_pipe(chisq: DataFrame, modified: bool = True) -> DataFrame:
    """(time_idx, chan, v, w): whole-array z-scores of chi-square, by antenna or as a total."""
    z = reduce.zscore_full(chisq, (), "v", modified)
    wf = reduce.collapse(z, ["time_idx", "chan"], "mean", "z")
    return reduce.infinite(wf, "v")


def xrfi_round(
    products: dict[str, tuple[DataFrame, Sequence[str]]], algorithm: str, first: float = 5.0, next_to: float = 2.0, kt: int = 8, kf: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(metrics, flags) of one round: products name -> (data, keys of waterfalls); `combined` is their joint metric."""
    metrics, found = None, []
    parts = []
    for name, (data, by) in products.items():
        m = metric_pipe(data, by, algorithm, kt, kf)
        parts.append(m)
        f = flags.watershed_flag(flags.flag_metric(m, first), next_to)
        found.append(f)
        one = f.select(F.lit(name).alias("product"), "time_idx", "chan", "v", "flag")
        metrics = one if metrics is None else metrics.unionByName(one)
    joint = [p.withColumns({"v": F.when(F.abs("v") < INF, F.col("v"))}) for p in parts]
    combined = reduce.infinite(reduce.combine_metrics(joint), "v")
    f = flags.watershed_flag(flags.flag_metric(combined, first), next_to)
    found.append(f)
    metrics = metrics.unionByName(f.select(F.lit("combined").alias("product"), "time_idx", "chan", "v", "flag"))
    return metrics, flags.any_flag(found)


def xrfi(
    products: dict[str, tuple[DataFrame, Sequence[str]]], apriori: DataFrame | None = None, med: tuple[float, float] = (10.0, 4.0), mean: tuple[float, float] = (5.0, 2.0),
    kt: int = 8, kf: int = 8,
) -> dict[str, DataFrame]:
    """Two rounds: median filters, whose flags leave the data, then mean filters; flags of both with the a-priori ones.

    Products are tables (keys, time_idx, chan, v) named in the result's metrics.
    """
    m1, f1 = xrfi_round(products, "detrend_medfilt", *med, kt, kf)
    if apriori is not None:
        f1 = flags.any_flag([f1, apriori])

    def cleaned(data: DataFrame) -> DataFrame:
        out = data.join(f1.withColumnRenamed("flag", "_f"), ["time_idx", "chan"], "left")
        return out.withColumn("v", F.when(~F.coalesce("_f", F.lit(False)), F.col("v"))).drop("_f")

    m2, f2 = xrfi_round({k: (cleaned(d), by) for k, (d, by) in products.items()}, "detrend_meanfilt", *mean, kt, kf)
    parts = [f1, f2] + ([apriori] if apriori is not None else [])
    return {"metrics1": m1, "flags1": f1, "metrics2": m2, "flags2": f2, "flags": flags.any_flag(parts)}


def day_threshold(
    second: DataFrame, first: DataFrame, round_flags: Sequence[DataFrame] = (), nsig: tuple[float, float, float, float] = (7.0, 7.0, 3.0, 3.0)
) -> DataFrame:
    """Flags of a day: whole channels and times of each product's metric (product, time_idx, chan, v), with those of the rounds.

    Infinite metrics of the second round are taken from the first.
    """
    m = reduce.fill_infinite(second, first, ("product", "time_idx", "chan"))
    f = flags.threshold_waterfall(m, *nsig, by=["product"])
    return flags.any_flag([f, *round_flags])


def fraction_thresholds(data_flags: DataFrame, px: float = 0.2, freq: float = 0.5, time: float = 0.05, method: str = "quadmean") -> DataFrame:
    """Waterfall flags from the collapsed shares of flagged baselines, by pixel, channel and integration."""
    wf = reduce.collapse(data_flags.withColumn("v", F.col("flag").cast("double")), ["time_idx", "chan"], method)
    return flags.flag_metric(wf, px, freq, time, method)


def firstcal_metrics(gains: DataFrame, std_cut: float = 0.5, by: Sequence[str] = ("ant", "antpol"), smooth: bool = False, each: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Delays (ns), their scatter per antenna, time and in all, and antennas beyond the cut or rotated.

    With each=("obs",), every observation has metrics of its own.
    """
    by = [*each, *(b for b in by if b not in each)]
    d = calibration.fit_delays(gains, [*by, "time_idx"]).withColumn("delay", F.col("delay_s") * 1e9)
    rotated = d.groupBy(*by).agg(F.bool_or("rotated").alias("rotated"))
    fluct = calibration.delay_fluctuations(d, by)
    if smooth:
        fluct = remove_drift(fluct, by)
    ant, time, agg = calibration.delay_std(fluct, by, each)
    ant = ant.join(rotated, by).withColumn("bad", (F.col("ant_std") > std_cut) | F.col("rotated"))
    return {"delays": fluct, "ants": ant, "times": time, "all": agg.withColumn("good", ~(F.col("max_std") > std_cut))}


def remove_drift(fluct: DataFrame, by: Sequence[str]) -> DataFrame:
    """Delay fluctuations without the slow part that a Gaussian process follows, fitted to each antenna.

    Times are fractions of a day where there is a `jd`, else of the run. A group
    is one antenna's integrations.
    """
    from arraylens.operators.kernels import gp_smooth

    names = fluct.columns

    def run(pdf):
        pdf = pdf.sort_values("time_idx")
        if "jd" in names:
            t = pdf["jd"].to_numpy(float) - pdf["jd"].min()
        else:
            t = pdf["time_idx"].to_numpy(float)
            t = (t - t.min()) / max(t.max() - t.min(), 1)
        return pdf.assign(fluct=pdf["fluct"] - gp_smooth(t, pdf["fluct"].to_numpy(float)))[names]

    return fluct.groupBy(*by).applyInPandas(run, fluct.schema)


def omnical_metrics(
    cal: DataFrame, firstcal: DataFrame | None = None, edge: int = 0, channels: int | None = None, phs_cut: float = 0.3, chisq_cut: float = 4.0, each: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Chi-square metrics of calibration solutions and, against firstcal gains, phase metrics.

    With each=("obs",), every observation has chi-square metrics of its own.
    """
    out = {"chisq": calibration.chisq_metric(cal, cut=chisq_cut, edge=edge, channels=channels, each=each), "chisq_time": calibration.chisq_over_time(cal, edge, channels, each)}
    if firstcal is not None:
        ratio = calibration.gain_ratio(cal, firstcal)
        p = calibration.phase_residuals(ratio)
        ant, time = calibration.phase_std(p, edge, channels)
        out |= {
            "phase": ant.withColumn("good", F.col("phs_std") < phs_cut), "phase_time": time, "phase_hist": calibration.phase_histogram(p),
            "phase_spectrum": grouped.phase_spectra(ratio),
        }
    return out


def flag_autos(
    autos: DataFrame, int_count: float, bad: Sequence[int] = (), nsig: float = 6.0, share: float = 0.1, widths: Sequence[int] = (3, 4, 5)
) -> tuple[DataFrame, DataFrame]:
    """(per antenna, array): channel-difference flags with radiometer noise; bad antennas are all flagged and don't vote."""
    from arraylens.operators.windows import channel_diff_flags

    x = autos.withColumn("noise", F.abs("v") / (int_count / 2) ** 0.5)
    f = channel_diff_flags(x, ["ant", "pol"], nsig, widths)
    array = flags.array_flags(f, share, list(bad))
    return flags.flag_antennas(f, list(bad)), array


def auto_rfi_class(
    autos: DataFrame, freqs: Sequence[float], int_count: float, bad: Sequence[int] = (), good=(0, 0.01), suspect=(0.01, 0.02), nsig: float = 6.0, share: float = 0.5,
    widths: Sequence[int] = (3, 4, 5), centers: Sequence[float] = (0.0,), half_widths: Sequence[float] = (200e-9,), cutoffs: Sequence[float] = (1e-9,),
) -> tuple[DataFrame, DataFrame]:
    """(classes, shares): antennas by the share of their pixels that are flagged beside the array's flags.

    Channel differences find first flags; pixels that a share of the antennas
    flags are the array's, and all antennas start the second step from these: a
    smooth model of each integration, fitted to what the array leaves. Bad
    antennas don't vote, are wholly flagged and are not classified.
    """
    from arraylens.operators import classify

    _, first = flag_autos(autos, int_count, bad, nsig, share, widths)
    x = autos.where(~F.col("ant").isin(*bad)) if bad else autos
    x = x.join(first.select("time_idx", "chan", F.col("flag").alias("_array")), ["time_idx", "chan"], "left")
    x = x.withColumns({"_array": F.coalesce("_array", F.lit(False)), "noise": F.abs("v") / (int_count / 2) ** 0.5})
    second = grouped.dpss_flags(x, ["ant", "pol"], freqs, centers, half_widths, nsig, cutoffs, flags="_array")
    second = second.withColumn("flag", F.col("flag") | F.col("_array")).drop("_array", "noise")
    array = flags.array_flags(second, share)
    value = classify.auto_rfi(second.withColumn("antpol", F.when(F.substring("pol", 1, 1) == "e", "Jee").otherwise("Jnn")), array)
    return classify.with_bad(value, "value", good, suspect), value


def seeds_to_flags(metric: DataFrame, first: float, next_to: float, by: Sequence[str] = ()) -> DataFrame:
    """Threshold and growth of a metric (by, time_idx, chan, v)."""
    return grouped.watershed(metric.withColumn("seed", at_least("v", first)), by, "v", "seed", next_to)

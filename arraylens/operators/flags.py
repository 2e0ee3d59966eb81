"""Thresholds, flag algebra and a-priori flags."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylens.functions.expr import at_least, finite, is_true
from arraylens.operators import grouped
from arraylens.operators.reduce import collapse, modzscore_1d


def flag_metric(
    metric: DataFrame, nsig_p: float | None = 6.0, nsig_f: float | None = None, nsig_t: float | None = None, method: str = "quadmean", by: Sequence[str] = (),
    value: str = "v", weight: str | None = None,
) -> DataFrame:
    """metric with `flag`: |value| >= nsig_p, or its channel's or integration's collapse reaches nsig_f or nsig_t."""
    by = list(by)
    out = metric.withColumn("flag", F.lit(False) if nsig_p is None else at_least(F.abs(value), nsig_p))
    for axis, nsig in (("chan", nsig_f), ("time_idx", nsig_t)):
        if nsig is not None:
            c = collapse(metric, [*by, axis], method, value, weight, "_c").withColumn("_hit", F.col("_c").isNull() | at_least(F.abs("_c"), nsig))
            out = out.join(c.select(*by, axis, "_hit"), [*by, axis], "left").withColumn("flag", F.col("flag") | is_true(F.col("_hit"))).drop("_hit")
    return out


def watershed_flag(
    metric: DataFrame, nsig_p: float = 2.0, nsig_f: float | None = None, nsig_t: float | None = None, method: str = "quadmean", by: Sequence[str] = (), value: str = "v", weight: str | None = None,
) -> DataFrame:
    """Grows `flag` over pixels, then fully flagged channels and integrations over their neighbours."""
    by = list(by)
    out = grouped.watershed(metric.withColumnRenamed("flag", "seed"), by, value, "seed", nsig_p).drop("seed")
    for axis, nsig in (("chan", nsig_f), ("time_idx", nsig_t)):
        if nsig is not None:
            c = collapse(out, [*by, axis], method, value, weight, "z").join(out.groupBy(*by, axis).agg(F.bool_and("flag").alias("seed")), [*by, axis])
            grown = grouped.watershed_series(c, by, axis, "z", "seed", nsig, "_hit").select(*by, axis, "_hit")
            out = out.join(grown, [*by, axis], "left").withColumn("flag", F.col("flag") | is_true(F.col("_hit"))).drop("_hit")
    return out


def threshold_waterfall(
    metric: DataFrame, nsig_f: float = 7.0, nsig_t: float = 7.0, next_f: float = 3.0, next_t: float = 3.0, by: Sequence[str] = (), value: str = "v", fix_nonfinite_time: bool = False
) -> DataFrame:
    """Flags whole channels and integrations by the size of the modified z of their medians, grown along the axis.

    A channel without any finite sample is flagged; an integration is so only
    with fix_nonfinite_time.
    """
    by = list(by)
    x = metric.withColumn("_x", finite(value))
    out = metric.withColumn("flag", F.lit(False))
    for axis, nsig, near, fix in (("chan", nsig_f, next_f, True), ("time_idx", nsig_t, next_t, fix_nonfinite_time)):
        z = modzscore_1d(x.groupBy(*by, axis).agg(F.median("_x").alias("_m")), by, "_m")
        z = z.withColumn("z", F.coalesce(F.abs(finite("z")), F.lit(float(nsig)) if fix else F.lit(None).cast("double")))
        z = z.withColumn("seed", at_least("z", nsig))
        grown = grouped.watershed_series(z, by, axis, "z", "seed", near, "_hit").select(*by, axis, "_hit")
        out = out.join(grown, [*by, axis], "left").withColumn("flag", F.col("flag") | is_true(F.col("_hit"))).drop("_hit")
    return out


def channel_share(flags: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """flags with whole channels added that have more than low + share * (times - low) flags."""
    by = list(by)
    n = flags.groupBy(*by, "chan").agg(F.count_if("flag").alias("_n"))
    low = n.groupBy(*by).agg(F.min("_n").alias("_low"))
    times = flags.groupBy(*by).agg((F.max("time_idx") - F.min("time_idx") + 1).alias("_t"))
    for one in (low, times):
        n = n.join(one, by) if by else n.crossJoin(F.broadcast(one))  # one row without groups
    busy = n.withColumn("_busy", F.col("_n") > F.col("_low") + share * (F.col("_t") - F.col("_low")))
    return flags.join(busy.select(*by, "chan", "_busy"), [*by, "chan"]).withColumn("flag", F.col("flag") | F.col("_busy")).drop("_busy")


def edge_mask(df: DataFrame, cut: int, channels: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with `edge`: whether a channel is one of the first or last `cut`."""
    if channels is None:
        df = df.crossJoin(F.broadcast(df.agg((F.max("chan") + 1).alias("_n"))))  # one row
    n = F.lit(channels) if channels is not None else F.col("_n")
    return df.withColumn("edge", (F.col("chan") < cut) | (F.col("chan") >= n - cut)).drop("_n")


def edge_times(flags: DataFrame, k: int, first: int, last: int) -> DataFrame:
    """Flags integrations within k of the first and last of the night."""
    near = (F.col("time_idx") < first + k) | (F.col("time_idx") > last - k)
    return flags.withColumn("flag", F.col("flag") | near)


# Flag algebra


def any_flag(products: Sequence[DataFrame], keys: Sequence[str] = ("time_idx", "chan")) -> DataFrame:
    """Union of flag products."""
    every = products[0].select(*keys, "flag")
    for p in products[1:]:
        every = every.unionByName(p.select(*keys, "flag"))
    return every.groupBy(*keys).agg(F.bool_or("flag").alias("flag"))


def all_flags(flags: DataFrame, keys: Sequence[str] = ("time_idx", "chan")) -> DataFrame:
    """Pixels that every waterfall flags."""
    return flags.groupBy(*keys).agg(F.bool_and("flag").alias("flag"))


def apply_flags(data: DataFrame, flags: DataFrame, keys: Sequence[str] = ("time_idx", "chan"), keep_existing: bool = True) -> DataFrame:
    """data with its `flag` OR-ed with the flags of its keys; `net_flag` has what flags alone say, or both."""
    f = flags.groupBy(*keys).agg(F.bool_or("flag").alias("_f"))
    out = data.join(f, list(keys), "left").withColumn("_f", is_true(F.col("_f")))
    net = F.col("flag") | F.col("_f") if keep_existing else F.col("_f")
    return out.withColumn("net_flag", net).withColumn("flag", F.col("flag") | F.col("_f")).drop("_f")


def of_antennas(df: DataFrame, xants: Sequence) -> Column:
    """Whether a row has one of the antennas, or of the (antenna, feed) pairs; df has ant1, ant2 and pol, or ant and antpol or pol.

    A row of an antenna without a feed has all its feeds; a baseline has the feed of each end that its polarization names.
    """
    whole = [x for x in xants if isinstance(x, int)]
    pairs = [x for x in xants if not isinstance(x, int)]
    if {"ant1", "ant2"} <= set(df.columns):
        ends = [("ant1", F.substring("pol", 1, 1)), ("ant2", F.substring("pol", 2, 1))]
    elif "ant" in df.columns:
        feed = F.substring("antpol", 2, 1) if "antpol" in df.columns else F.substring("pol", 1, 1) if "pol" in df.columns else None
        ends = [("ant", feed)]
    else:
        raise ValueError("waterfalls without antennas can't be flagged by antenna")
    hit = F.lit(False)
    for ant, feed in ends:
        hit |= F.col(ant).isin(*whole)
        for a, p in pairs:
            hit |= (F.col(ant) == a) & (F.lit(True) if feed is None else feed == p[1])
    return hit


def flag_antennas(df: DataFrame, xants: Sequence) -> DataFrame:
    """Flags all rows of the antennas or (antenna, feed) pairs."""
    return df.withColumn("flag", F.col("flag") | of_antennas(df, xants)) if xants else df


def array_flags(flags: DataFrame, share: float = 0.1, bad: Sequence[int] = ()) -> DataFrame:
    """(time_idx, chan, share, flag): pixels that a share of the other antennas flag."""
    ok = flags.where(~F.col("ant").isin(*bad)) if bad else flags
    m = F.avg(F.col("flag").cast("double"))
    return ok.groupBy("time_idx", "chan").agg(m.alias("share")).withColumn("flag", F.col("share") >= share)


# A-priori flags


def load_flag_spec(spark: SparkSession, path: str) -> dict:
    """A flag specification in JSON or YAML (where PyYAML is installed), from any path that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def _ranges(items: Sequence, kind: type, what: str) -> list[tuple]:
    out = []
    for x in items or []:
        if isinstance(x, int) and not isinstance(x, bool) and kind is int:
            x = [x, x]
        if not isinstance(x, (list, tuple)) or len(x) != 2:
            raise TypeError(f"{what} must hold ranges of two, not {x!r}")
        out.append((kind(x[0]), kind(x[1])))
    return out


def a_priori_channels(spec: dict, freqs: DataFrame) -> DataFrame:
    """(chan): channels of freqs (chan, freq_hz) in inclusive channel or frequency ranges."""
    c = _ranges(spec.get("channel_flags"), int, "channel_flags")
    f = _ranges(spec.get("freq_flags"), float, "freq_flags")
    if any(a > b for a, b in c + f):
        raise ValueError("ranges must ascend")
    hit = F.lit(False)
    for a, b in c:
        hit |= F.col("chan").between(a, b)
    for a, b in f:
        hit |= F.col("freq_hz").between(a, b)
    return freqs.where(hit).select("chan").distinct()


def a_priori_times(spec: dict, times: DataFrame) -> DataFrame:
    """(time_idx): integrations of times (time_idx, jd, lst_hr) in inclusive ranges; LST ranges may wrap at 24 h."""
    i = _ranges(spec.get("integration_flags"), int, "integration_flags")
    j = _ranges(spec.get("JD_flags"), float, "JD_flags")
    lst = _ranges(spec.get("LST_flags"), float, "LST_flags")
    if any(a > b for a, b in i + j):
        raise ValueError("ranges must ascend")
    if any(not 0 <= x <= 24 for r in lst for x in r):
        raise ValueError("LSTs must lie between 0 and 24 hours")
    hit = F.lit(False)
    for a, b in i:
        hit |= F.col("time_idx").between(a, b)
    for a, b in j:
        hit |= F.col("jd").between(a, b)
    for a, b in lst:
        inside = F.col("lst_hr").between(a, b) if a <= b else (F.col("lst_hr") >= a) | (F.col("lst_hr") <= b)
        hit |= inside
    return times.where(hit).select("time_idx").distinct()


def a_priori_antennas(spec: dict, indices_only: bool = False, by_ant_pol: bool = False, ant_pols: Sequence[str] | None = None) -> list:
    """Antennas of a specification: as given, as numbers, or as (antenna, feed) pairs."""
    if indices_only and by_ant_pol:
        raise ValueError("indices_only and by_ant_pol exclude each other")
    if by_ant_pol and not ant_pols:
        raise ValueError("by_ant_pol needs ant_pols")
    given = []
    for x in spec.get("ex_ants") or []:
        if isinstance(x, int):
            given.append(x)
        elif isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[0], int) and isinstance(x[1], str):
            given.append((x[0], x[1]))
        else:
            raise TypeError(f"ex_ants must be antennas or pairs of antenna and feed, not {x!r}")
    if indices_only:
        return sorted({x if isinstance(x, int) else x[0] for x in given})
    if by_ant_pol:
        return sorted({(x, p) for x in given if isinstance(x, int) for p in ant_pols} | {x for x in given if isinstance(x, tuple)})
    return given


def apply_a_priori(
    data: DataFrame, spec: dict, freqs: DataFrame, times: DataFrame, flag_ants: bool = True, flag_freqs: bool = True, flag_times: bool = True, unflag_first: bool = False,
    drop_antennas: bool = False,
) -> DataFrame:
    """data with the a-priori flags; indices beyond the data are ignored. The lists of channels, times and antennas come from the specification."""
    out = data.withColumn("flag", F.lit(False)) if unflag_first else data
    for on, axis, hits in ((flag_freqs, "chan", a_priori_channels(spec, freqs)), (flag_times, "time_idx", a_priori_times(spec, times))):
        if on:
            out = out.join(hits.withColumn("_hit", F.lit(True)), axis, "left").withColumn("flag", F.col("flag") | is_true(F.col("_hit"))).drop("_hit")
    ants = a_priori_antennas(spec) if flag_ants else []
    if drop_antennas and ants:
        return out.where(~of_antennas(out, ants))
    return flag_antennas(out, ants)


def ex_antennas(spark: SparkSession, given: str = "", metrics: Sequence[DataFrame] = ()) -> list[int]:
    """Sorted antennas of a comma-separated list and of tables of excluded antennas (ant); feeds are dropped."""
    out = set()
    for x in filter(None, (y.strip() for y in given.split(","))):
        if not x.isdigit():
            raise AssertionError(f"{x!r} is no antenna number")
        out.add(int(x))
    for m in metrics:
        out |= {r["ant"] for r in m.select("ant").distinct().collect()}
    return sorted(out)

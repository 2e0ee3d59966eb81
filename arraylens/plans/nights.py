"""Interference flagging of whole nights, from visibilities and calibration solutions.

Products are tables (night, obs, time_idx, chan, keys, v). Those of kind `filter`
are detrended in chunks, those of kind `chisq` scored against the whole night.
Every product gives a metric waterfall of each night; thresholds and growth run
on these, as do the joint metric and the flags that go back onto solutions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylens.functions.expr import INF
from arraylens.operators import flags, grouped, nights, reduce

KEYS = ["night", "obs", "time_idx", "chan"]
#: Writes a result under a name and reads it back, so that what follows does not compute it again.
Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


@dataclass(frozen=True)
class Product:
    """A table with the keys of its waterfalls, its kind, and the rounds (1 and 2) that use it."""

    data: DataFrame
    by: Sequence[str] = ()
    kind: str = "filter"
    rounds: Sequence[int] = field(default=(1, 2))


def vis_products(vis: DataFrame, autos: bool = True, crosses: bool = True) -> dict[str, Product]:
    """Autocorrelations and cross-correlations (ant1, ant2, pol, re, im) as products of their own."""
    v = vis.withColumn("v", F.hypot("re", "im"))
    by = ["ant1", "ant2", "pol"]
    found = {"auto": Product(v.where("ant1 = ant2"), by)} if autos else {}
    return found | ({"cross": Product(v.where("ant1 <> ant2"), by)} if crosses else {})


def cal_products(cal: DataFrame, name: str, gains: bool = True, chisq: bool = True) -> dict[str, Product]:
    """Gain amplitudes and chi-square by antenna of one calibration (ant, antpol, gain_re, gain_im, chisq)."""
    found = {}
    if gains:
        found[f"{name}_gain"] = Product(cal.withColumn("v", F.hypot("gain_re", "gain_im")), ["ant", "antpol"])
    if chisq:
        found[f"{name}_chisq"] = Product(cal.withColumn("v", F.col("chisq")), ["ant", "antpol"], "chisq")
    return found


def total_product(total: DataFrame, name: str) -> dict[str, Product]:
    """Chi-square of all antennas together (antpol, total_chisq)."""
    return {f"{name}_total": Product(total.withColumn("v", F.col("total_chisq")), ["antpol"], "chisq")}


def waterfall_metric(product: Product, algorithm: str, kt: int = 8, kf: int = 8, method: str = "quadmean") -> DataFrame:
    """(night, obs, time_idx, chan, v, w): the metric of a product; w is 1 where there are data."""
    unflagged = product.data.withColumn("v", F.when(~F.col("flag"), F.col("v"))) if "flag" in product.data.columns else product.data
    if product.kind == "chisq":
        z = reduce.zscore_full(unflagged, ["night"], "v", algorithm == "detrend_medfilt")
        wf = reduce.collapse(z.withColumn("z", F.when(F.abs("z") < INF, F.col("z"))), KEYS, "mean", "z")
        return reduce.infinite(wf.withColumn("w", F.when(F.col("w") > 0, 1.0).otherwise(0.0)), "v")
    z = nights.detrend(unflagged, product.by, algorithm, kt, kf, "v")
    wf = reduce.collapse(z.withColumn("z", F.when(F.abs("z") < INF, F.col("z"))), KEYS, method, "z")
    wf = wf.withColumn("w", F.when(F.col("w") > 0, 1.0).otherwise(0.0))
    again = nights.detrend(wf, [], algorithm, kt, kf, "v")
    return reduce.infinite(again.select(*KEYS, F.when(F.abs("z") < INF, F.col("z")).alias("v"), "w"), "v")


def grown(metric: DataFrame, first: float, next_to: float) -> DataFrame:
    """Pixels of a night's metric beyond `first`, and their neighbours beyond next_to."""
    return flags.watershed_flag(flags.flag_metric(metric, first, by=["night"]), next_to, by=["night"])


def flag_round(products: Mapping[str, Product], n: int, algorithm: str, first: float, next_to: float, kt: int = 8, kf: int = 8, keep: Keep = _as_is) -> tuple[DataFrame, DataFrame]:
    """(metrics, flags) of round n: each product's metric and `combined`, their joint one, and the union of their flags."""
    parts = {name: keep(waterfall_metric(p, algorithm, kt, kf), f"round{n}_{name}") for name, p in products.items() if n in p.rounds}
    if not parts:
        raise ValueError(f"no product takes part in round {n}")
    joint = [m.withColumn("v", F.when(F.abs("v") < INF, F.col("v"))) for m in parts.values()]
    parts["combined"] = reduce.infinite(reduce.combine_metrics(joint, KEYS), "v")
    metrics = None
    for name, m in parts.items():
        one = grown(m, first, next_to).select(F.lit(name).alias("product"), *KEYS, "v", "flag")
        metrics = one if metrics is None else metrics.unionByName(one)
    metrics = keep(metrics, f"metrics{n}")
    return metrics, metrics.groupBy(*KEYS).agg(F.bool_or("flag").alias("flag"))


def without(products: Mapping[str, Product], found: DataFrame) -> dict[str, Product]:
    """Products whose samples at flagged pixels are missing."""
    f = found.select("night", "time_idx", "chan", F.col("flag").alias("_f"))

    def clean(data: DataFrame) -> DataFrame:
        return data.join(f, ["night", "time_idx", "chan"], "left").withColumn("v", F.when(~F.coalesce("_f", F.lit(False)), F.col("v"))).drop("_f")

    return {name: Product(clean(p.data), p.by, p.kind, p.rounds) for name, p in products.items()}


def xrfi(
    products: Mapping[str, Product], apriori: DataFrame | None = None, med: tuple[float, float] = (10.0, 4.0), mean: tuple[float, float] = (5.0, 2.0), kt: int = 8, kf: int = 8,
    edges: bool = True, keep: Keep = _as_is,
) -> dict[str, DataFrame]:
    """Two rounds of a night, median filters and then mean filters on what is left; `flags` has both and the a-priori ones.

    With edges, the first and last kt integrations of each night are flagged in the second round. keep may write each
    product's metric and each round's results, all of the size of waterfalls.
    """
    m1, f1 = flag_round(products, 1, "detrend_medfilt", *med, kt, kf, keep)
    if apriori is not None:
        f1 = flags.any_flag([f1, f1.select(*KEYS).join(apriori.select("night", "time_idx", "chan", "flag"), ["night", "time_idx", "chan"])], KEYS)
    f1 = keep(f1, "flags1")
    m2, f2 = flag_round(without(products, f1), 2, "detrend_meanfilt", *mean, kt, kf, keep)
    f2 = keep(nights.edge_times(f2, kt) if edges else f2, "flags2")
    return {"metrics1": m1, "flags1": f1, "metrics2": m2, "flags2": f2, "flags": keep(flags.any_flag([f1, f2], KEYS), "flags")}


def flag_solutions(cal: DataFrame, found: DataFrame, bad: Sequence = ()) -> DataFrame:
    """A calibration table with a night's flags added to its own, antenna by antenna; bad antennas are flagged whole.

    Gains of flagged solutions become 1, so that applying them leaves the data as they are.
    """
    out = flags.flag_antennas(flags.apply_flags(cal, found, ("night", "time_idx", "chan")).drop("net_flag"), bad)
    return out.withColumns({"gain_re": F.when(F.col("flag"), 1.0).otherwise(F.col("gain_re")), "gain_im": F.when(F.col("flag"), 0.0).otherwise(F.col("gain_im"))})


# Flags of single baselines, folded into waterfalls and back


def baseline_flags(vis: DataFrame, by: Sequence[str] = ("ant1", "ant2", "pol"), kt: int = 8, kf: int = 8, first: float = 6.0, next_to: float = 2.0, algorithm: str = "detrend_medfilt") -> DataFrame:
    """vis (by, time_idx, chan, v) with the flags of each baseline's own waterfall."""
    return grouped.xrfi(vis, by, kt, kf, first, next_to, algorithm)


def share_waterfall(found: DataFrame, px: float = 0.2, freq: float = 0.5, time: float = 0.05, method: str = "quadmean") -> DataFrame:
    """(time_idx, chan, v, flag): pixels, channels and integrations that a large share of the waterfalls in `found` flag."""
    wf = reduce.collapse(found.withColumn("v", F.col("flag").cast("double")), ["time_idx", "chan"], method)
    return flags.flag_metric(wf, px, freq, time, method).select("time_idx", "chan", "v", "flag")


def h1c_run(vis: DataFrame, cal: DataFrame | None = None, px: float = 0.2, freq: float = 0.5, time: float = 0.05, kt: int = 8, kf: int = 8, first: float = 6.0, next_to: float = 2.0) -> dict[str, DataFrame]:
    """Flags of each baseline, of each antenna's gains and chi-square, and the waterfalls of their shares."""
    out = {"vis": baseline_flags(vis, ("ant1", "ant2", "pol"), kt, kf, first, next_to)}
    if cal is not None:
        for name, v in (("gain", F.hypot("gain_re", "gain_im")), ("chisq", F.col("chisq"))):
            out[name] = baseline_flags(cal.withColumn("v", v), ("ant", "antpol"), kt, kf, first, next_to)
    return out | {f"{k}_waterfall": share_waterfall(f, px, freq, time) for k, f in list(out.items())}


def h1c_apply(vis: DataFrame, waterfalls: Sequence[DataFrame], bad: Sequence = ()) -> DataFrame:
    """vis with the union of the waterfalls' flags on every baseline; flags that stand are kept, bad antennas flagged whole."""
    return flags.flag_antennas(flags.apply_flags(vis, flags.any_flag(waterfalls)).drop("net_flag"), bad)

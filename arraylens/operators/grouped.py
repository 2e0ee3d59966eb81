"""Kernels on long tables: one Arrow group for each waterfall.

A group is one waterfall, whose size is that of one antenna's or baseline's
observation; groups of many waterfalls are spread by their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arraylens.operators import kernels


def dense(pdf: pd.DataFrame, value: str, fill: float = np.nan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (time, channel) array of a group and the places of its rows in it."""
    t, f = pdf["time_idx"].to_numpy(), pdf["chan"].to_numpy()
    x = np.full((t.max() + 1, f.max() + 1), fill)
    x[t, f] = pdf[value].to_numpy(float)
    return x, t, f


def apply_waterfall(
    df: DataFrame, by: Sequence[str], kernel: Callable[[dict[str, np.ndarray]], np.ndarray], values: Sequence[str], out: str, kind: T.DataType
) -> DataFrame:
    """df with a column of the kernel's result; the kernel gets the dense arrays of `values` of one waterfall."""
    keys = list(by)
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, kind)])
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for v in values:
            arrays[v], t, f = dense(pdf, v)
        return pdf.assign(**{out: kernel(arrays)[t, f]})[names]

    return df.groupBy(*keys).applyInPandas(run, schema)


def detrend(df: DataFrame, by: Sequence[str], algorithm: str, kt: int = 8, kf: int = 8, value: str = "v", flag: str | None = None, out: str = "z") -> DataFrame:
    """A named algorithm on each waterfall; unknown names raise KeyError. NaN where samples are missing."""
    f = kernels.ALGORITHMS[algorithm]

    def kernel(a: dict[str, np.ndarray]) -> np.ndarray:
        flags = None if flag is None else a[flag] == 1
        return f(a[value], flags, kt, kf)

    return apply_waterfall(df, by, kernel, [value] + ([flag] if flag else []), out, T.DoubleType())


def xrfi(
    df: DataFrame, by: Sequence[str], kt: int = 8, kf: int = 8, first: float = 6.0, next_to: float = 2.0, algorithm: str = "detrend_medfilt", value: str = "v", out: str = "flag"
) -> DataFrame:
    """Metric, threshold and watershed of each waterfall in one kernel."""
    if algorithm not in kernels.ALGORITHMS:
        raise KeyError(algorithm)
    return apply_waterfall(df, by, lambda a: kernels.xrfi_waterfall(a[value], None, kt, kf, first, next_to, algorithm), [value], out, T.BooleanType())


def simple_flags(df: DataFrame, by: Sequence[str], value: str = "v", out: str = "flag", **how) -> DataFrame:
    return apply_waterfall(df, by, lambda a: kernels.simple_flag_waterfall(a[value], **how), [value], out, T.BooleanType())


def watershed(df: DataFrame, by: Sequence[str], metric: str = "z", seed: str = "seed", nsig: float = 2.0, out: str = "flag") -> DataFrame:
    """Grows seeds over each waterfall; missing samples never grow."""
    return apply_waterfall(df, by, lambda a: kernels.watershed(a[metric], a[seed] == 1, nsig), [metric, seed], out, T.BooleanType())


def watershed_series(df: DataFrame, by: Sequence[str], order: str, metric: str = "z", seed: str = "seed", nsig: float = 2.0, out: str = "flag") -> DataFrame:
    """Watershed of series: both neighbours along `order`."""
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, T.BooleanType())])
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[order].to_numpy()
        x, s = np.full(at.max() + 1, np.nan), np.zeros(at.max() + 1, bool)
        x[at], s[at] = pdf[metric].to_numpy(float), pdf[seed].to_numpy(bool)
        return pdf.assign(**{out: kernels.watershed(x, s, nsig)[at]})[names]

    return df.groupBy(*by).applyInPandas(run, schema)


def dpss_flags(
    df: DataFrame, by: Sequence[str], freqs: Sequence[float], centers: Sequence[float] = (0.0,), half_widths: Sequence[float] = (2e-7,), nsig: float = 6.0,
    cutoffs: Sequence[float] = (1e-9,), value: str = "v", noise: str = "noise", out: str = "flag", flags: str | None = None,
) -> DataFrame:
    """Smooth-model flags of each waterfall; freqs are the channels' frequencies in Hz. Samples that `flags` has are not fitted."""
    f = np.array(freqs)

    def kernel(a: dict[str, np.ndarray]) -> np.ndarray:
        before = None if flags is None else a[flags] == 1
        return kernels.dpss_flagger(a[value], a[noise], f[: a[value].shape[1]], list(centers), list(half_widths), before, nsig, list(cutoffs))

    return apply_waterfall(df, by, kernel, [value, noise] + ([flags] if flags else []), out, T.BooleanType())


def convolution_flags(df: DataFrame, by: Sequence[str], ok: tuple[float, float], sigma: float = 30, longest: int = 30, order: str = "idx", metric: str = "metric", start: str = "flag") -> DataFrame:
    """Flags of time series, grown by the smoothed metric."""
    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        grown = kernels.convolution_flagging(pdf[metric].to_numpy(float), pdf[start].to_numpy(bool), ok, sigma, longest)
        return pdf.assign(**{start: grown})[names]

    return df.groupBy(*by).applyInPandas(run, df.schema)


def phase_spectra(gains: DataFrame, by: Sequence[str] = ("ant", "antpol")) -> DataFrame:
    """(by, mode, power): delay spectra of gain ratios (re, im), a median over time."""
    keys = list(by)
    schema = T.StructType([f for f in gains.schema if f.name in keys] + [T.StructField("mode", T.IntegerType()), T.StructField("power", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        re, _, _ = dense(pdf, "re")
        im, _, _ = dense(pdf, "im")
        p = kernels.phase_spectrum(re + 1j * im)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in keys} | {"mode": np.arange(len(p), dtype="int32") - len(p) // 2, "power": p})

    return gains.groupBy(*keys).applyInPandas(run, schema)

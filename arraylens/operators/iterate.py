"""Searches for misbehaving antennas.

The loops run on the driver over tables with one row for a pair of antennas or
for an antenna, whose size the array fixes and not its data; Spark reduces the
samples to them first. MAX_ROWS guards that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from arraylens.operators import reduce
from arraylens.schema import ANT_METRIC, EX_ANTS

#: Most rows of an antenna or pair table that the driver takes.
MAX_ROWS = 4_000_000
FEED = {"ee": "Jee", "nn": "Jnn"}


def small(df: DataFrame) -> pd.DataFrame:
    got = df.limit(MAX_ROWS + 1).toPandas()
    if len(got) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows; reduce the table to antennas first")
    return got


def antenna_search(edges: DataFrame, cross_cut: float = 0.0, dead_cut: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(excluded, metrics) from correlation edges (pol, ant1, ant2, corr, both directions).

    Totally dead antennas go first. Then, in each iteration, the single worst
    antenna goes: both feeds if its cross-polarization metric is below
    cross_cut and no larger than the smallest distance of the correlations, one
    feed if its correlation is below dead_cut. Ties go to the first by feed,
    then antenna. Metrics have a row for each iteration.
    """
    spark = edges.sparkSession
    e = small(edges)
    ants = np.array(sorted(set(e["ant1"])))
    place = {a: i for i, a in enumerate(ants)}
    m = {p: np.full((len(ants), len(ants)), np.nan) for p in ("ee", "nn", "en", "ne")}
    for r in e.itertuples():
        if r.pol in m:
            m[r.pol][place[r.ant1], place[r.ant2]] = r.corr
    cross = [p for p in ("en", "ne") if np.isfinite(m[p]).any()]
    excluded: list[tuple] = []
    metrics: list[tuple] = []
    gone: set[tuple[int, str]] = set()

    def blank(i: int, pols: Sequence[str]) -> None:
        for p in pols:
            m[p][i, :] = m[p][:, i] = np.nan

    def mean(a: np.ndarray) -> float:
        return float(np.nanmean(a)) if np.isfinite(a).any() else np.nan

    for p in ("ee", "nn"):
        for i, a in enumerate(ants):
            x = m[p][i]
            if np.isfinite(m[p]).any() and (not np.isfinite(x).any() or np.nanmedian(x) == 0):
                gone.add((int(a), p))
                excluded.append((int(a), FEED[p], "dead", -1))
    for a, p in gone:
        blank(place[a], [p, "en", "ne"])
    for n in range(2 * len(ants) + 1):
        corr = {(int(a), p): mean(m[p][i]) for p in ("ee", "nn") for i, a in enumerate(ants) if (int(a), p) not in gone}
        xpol = {}
        for i, a in enumerate(ants):
            if cross and any((int(a), p) in corr for p in ("ee", "nn")):
                d = [mean(m[s][i] - m[x][i]) for s in ("ee", "nn") for x in cross]
                xpol[int(a)] = np.nanmax(d) if np.isfinite(d).any() else np.nan
        metrics += [("corr", a, FEED[p], n, v) for (a, p), v in corr.items() if np.isfinite(v)]
        metrics += [("corrXPol", a, f, n, float(v)) for a, v in xpol.items() if np.isfinite(v) for f in ("Jee", "Jnn")]
        crossed = min(((v - cross_cut, a) for a, v in xpol.items() if np.isfinite(v)), default=(np.inf, None))
        dead = min(((v - dead_cut, p, a) for (a, p), v in corr.items() if np.isfinite(v)), default=(np.inf, None, None))
        if crossed[0] < 0 and crossed[0] <= dead[0]:
            a = crossed[1]
            blank(place[a], list(m))
            for p in ("ee", "nn"):
                if (a, p) not in gone:
                    gone.add((a, p))
                    excluded.append((a, FEED[p], "crossed", n))
        elif dead[0] < 0:
            _, p, a = dead
            blank(place[a], [p, "en", "ne"])
            gone.add((a, p))
            excluded.append((a, FEED[p], "dead", n))
        else:
            break
    return spark.createDataFrame(excluded, EX_ANTS), spark.createDataFrame(metrics, ANT_METRIC)


def modz_search(spectra: DataFrame, prior: Sequence[int] = (), cut: float = 5.0, on_abs: bool = False, **how) -> tuple[list[int], DataFrame | None]:
    """(excluded, scores): excludes the antenna with the largest modified z until none is above the cut.

    Scores are those of the last pass; None if every antenna was excluded before.
    Ties go to the first antenna, then polarization. The spectra of an array are
    small, so they are read once and the passes run on the driver.
    """
    spark = spectra.sparkSession
    s = small(spectra.select("ant", "pol", "chan", "s")).dropna()
    out, scores = list(prior), None
    every = set(s["ant"])
    while every - set(out):
        z = modz(s, out, **how)
        scores = z
        left = z[~z["ant"].isin(out)].dropna(subset=["z"])
        left = left.assign(key=left["z"].abs() if on_abs else left["z"]).sort_values(["key", "ant", "pol"], ascending=[False, True, True])
        if not len(left) or not left["key"].iloc[0] > cut:
            break
        out.append(int(left["ant"].iloc[0]))
    return sorted(set(out)), None if scores is None else spark.createDataFrame(scores, "ant int, pol string, d double, z double")


def modz(
    s: pd.DataFrame, ex_ants: Sequence[int] = (), overall: str = "median", metric: str = "median", power: float = 1.0, log: bool = False, abs_diff: bool = True
) -> pd.DataFrame:
    """reduce.spectrum_modz on the driver's copy of the spectra (ant, pol, chan, s)."""
    ref = s[~s["ant"].isin(ex_ants)].groupby(["pol", "chan"])["s"].agg(overall).rename("ref").reset_index()
    b = s.merge(ref, on=["pol", "chan"])
    with np.errstate(all="ignore"):
        x = np.log(b["s"].where(b["s"] > 0)) - np.log(b["ref"].where(b["ref"] > 0)) if log else b["s"] - b["ref"]
    x = x.abs() if abs_diff else x
    d = b.assign(d=x**power).groupby(["ant", "pol"])["d"].agg(metric).reset_index()
    kept = d.loc[~d["ant"].isin(ex_ants), "d"]
    med = kept.median()
    mad = (kept - med).abs().median()
    with np.errstate(all="ignore"):
        return d.assign(z=(d["d"] - med) / np.float64(mad) / reduce.MAD_AUTO)


def auto_pass(autos: DataFrame, n: int, ex: Sequence[int], cut: float) -> tuple[set[int], dict[str, DataFrame | None]]:
    """(excluded, scores by metric) of round n's four metrics, each of which starts from `ex`."""
    after, scores = set(ex), {}
    for name, (spec, dist) in reduce.AUTO_METRICS[n].items():
        spectra = reduce.auto_spectra(autos, **spec, **({"ex_ants": ex} if spec.get("waterfall_norm") and n == 2 else {}))
        found, scores[name] = modz_search(spectra, ex, cut, **dist)
        after |= set(found)
    return after, scores


def auto_search(autos: DataFrame, cuts: tuple[float, float] = (8.0, 4.0), prior: Sequence[int] = ()) -> tuple[list[int], list[int]]:
    """(first, second): antennas excluded after each round; a round's four metrics start from one set, whose union with
    what they exclude is the next pass's set, until none excludes more.

    The second round divides by waterfalls of the antennas still kept, which
    Spark reduces anew in each pass.
    """
    ex = list(prior)
    rounds = []
    for n, cut in zip((1, 2), cuts, strict=True):
        while True:
            after, _ = auto_pass(autos, n, ex, cut)
            if after == set(ex):
                break
            ex = sorted(after)
        rounds.append(sorted(set(ex)))
    return rounds[0], rounds[1]


def blame(counts: DataFrame, value: str = "n") -> DataFrame:
    """(ant, antpol, n): what each antenna is blamed for, from rows (ant1, antpol1, ant2, antpol2, value) of baselines.

    Antennas are walked by falling sums over their baselines; each takes the
    largest value of the baselines that no one has taken before, which leave.
    """
    c = small(counts)
    ends = [(r.ant1, r.antpol1, r.ant2, r.antpol2, getattr(r, value)) for r in c.itertuples()]
    total: dict[tuple, float] = {}
    for a, p, b, q, n in ends:
        for key in ((a, p), (b, q)):
            total[key] = total.get(key, 0) + n
    left, out = list(ends), []
    for key in sorted(total, key=lambda k: (-total[k], k)):
        own = [x for x in left if key in ((x[0], x[1]), (x[2], x[3]))]
        out.append((int(key[0]), key[1], float(max((x[4] for x in own), default=0))))
        left = [x for x in left if x not in own] if own else left
    return counts.sparkSession.createDataFrame(out, "ant int, antpol string, n double")

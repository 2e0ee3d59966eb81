"""Nights of observations: chunks with halos against whole nights, products, and flags of shares."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arraylens.operators import kernels, nights
from arraylens.plans import nights as plans

#: Integrations of each observation of two nights.
OBS = {1: [9, 4, 7], 2: [12, 11]}


def table(spark, arrays, **more):
    """(night, obs, time_idx, chan, v) from arrays by night; lengths of observations from OBS."""
    parts = []
    for night, x in arrays.items():
        t, f = np.indices(x.shape)
        obs = np.repeat([f"{night}.{i}" for i in range(len(OBS[night]))], OBS[night])
        parts.append(pd.DataFrame({"night": night, "obs": obs[t.ravel()], "time_idx": t.ravel().astype("int32"), "chan": f.ravel().astype("int32"), "v": x.ravel(), **more}))
    return spark.createDataFrame(pd.concat(parts))


def sky(seed, chans=12):
    rng = np.random.default_rng(seed)
    return {n: 50 + rng.normal(size=(sum(k), chans)) for n, k in OBS.items()}


def back(rows, value, chans=12):
    out = {n: np.full((sum(k), chans), np.nan) for n, k in OBS.items()}
    for r in rows:
        out[r.night][r.time_idx, r.chan] = r[value]
    return out


@pytest.mark.parametrize("algorithm", ["detrend_medfilt", "detrend_meanfilt", "detrend_medminfilt"])
def test_chunks_equal_whole_nights(spark, algorithm):
    x = sky(1)
    got = nights.detrend(table(spark, x).withColumn("ant", F.lit(3)), ["ant"], algorithm, 2, 2)
    assert set(got.columns) == {"night", "obs", "time_idx", "chan", "v", "ant", "z"}
    z = back(got.collect(), "z")
    for n in x:
        assert np.allclose(z[n], kernels.ALGORITHMS[algorithm](x[n], None, 2, 2))


def test_halo_rows_and_numbers(spark):
    df = table(spark, sky(2, 1))
    halo = nights.with_halo(df, 3).collect()
    for night, sizes in OBS.items():
        ends = np.cumsum(sizes)
        for i, end in enumerate(ends):
            lo, hi = end - sizes[i], end - 1
            mine = sorted((r.time_idx, r.at, r.home) for r in halo if r.chunk == f"{night}.{i}")
            want = [t for t in range(ends[-1]) if lo - 3 <= t <= hi + 3]
            assert mine == [(t, t - want[0], lo <= t <= hi) for t in want]
    local = df.withColumn("time_idx", (F.col("time_idx") - F.min("time_idx").over(plans_window())).cast("int"))
    again = nights.numbered(local)
    key = lambda r: (r.night, r.obs, r.time_idx, r.chan, r.v)
    assert sorted(map(key, again.collect())) == sorted(map(key, df.collect()))
    with pytest.raises(ValueError):
        nights.detrend(df, [], "detrend_deriv")
    with pytest.raises(KeyError):
        nights.detrend(df, [], "nothing")


def plans_window():
    from pyspark.sql import Window

    return Window.partitionBy("night", "obs")


def test_run_in_observations_equals_run_in_one(spark):
    """Two rounds over several products; a night as one observation gives the same metrics and flags."""
    auto, chi = sky(3), sky(4)
    auto[1][5, 6] += 400
    chi[1][11:13, 3] += 300  # in chi-square alone
    a, c = table(spark, auto).withColumn("ant", F.lit(1)), table(spark, chi).withColumn("ant", F.lit(1))

    def run(one):
        make = (lambda d: d.withColumn("obs", F.lit("x"))) if one else (lambda d: d)
        products = {"auto": plans.Product(make(a), ["ant"]), "chisq": plans.Product(make(c), ["ant"], "chisq")}
        out = plans.xrfi(products, med=(8.0, 4.0), mean=(6.0, 3.0), kt=2, kf=2)
        metric = {(r.product, r.night, r.time_idx, r.chan): r.v for r in out["metrics1"].collect()}
        return metric, back(out["flags"].collect(), "flag"), out

    whole, flags, _ = run(True)
    chunks, again, out = run(False)
    assert whole.keys() == chunks.keys()
    assert all(whole[k] == chunks[k] or abs(whole[k] - chunks[k]) < 1e-9 for k in whole)
    assert all(np.array_equal(flags[n], again[n]) for n in flags)
    assert again[1][5, 6] and again[1][11, 3] and again[1][12, 3]
    edges = {n: np.r_[0:2, -2:0] for n in OBS}
    assert all(again[n][edges[n]].all() for n in OBS)
    inner = again[2][2:-2]
    assert inner.mean() < 0.2
    products = {"auto": plans.Product(a, ["ant"])}
    with pytest.raises(ValueError):
        plans.flag_round({"auto": plans.Product(a, ["ant"], rounds=(1,))}, 2, "detrend_meanfilt", 5, 2)
    alone = back(plans.flag_round(products, 1, "detrend_medfilt", 8.0, 4.0, 2, 2)[1].collect(), "flag")
    assert alone[1][5, 6] and not alone[1][11, 3]

    cal = c.select("night", "obs", "time_idx", "chan", "ant", F.lit("Jee").alias("antpol"), F.lit(2.0).alias("gain_re"), F.lit(1.0).alias("gain_im"), (F.col("chan") == 0).alias("flag"))
    cal = cal.unionByName(cal.withColumn("ant", F.lit(9)))
    rows = plans.flag_solutions(cal, out["flags"], [9]).collect()
    for r in rows:
        want = r.ant == 9 or r.chan == 0 or bool(again[r.night][r.time_idx, r.chan])
        assert r.flag == want and (r.gain_re, r.gain_im) == ((1.0, 0.0) if want else (2.0, 1.0))


def test_products_of_tables(spark):
    vis = spark.createDataFrame([(1, 1, "ee", 3.0, 4.0), (1, 2, "ee", 6.0, 8.0)], "ant1 int, ant2 int, pol string, re double, im double")
    got = plans.vis_products(vis)
    assert [(n, [r.v for r in p.data.collect()]) for n, p in got.items()] == [("auto", [5.0]), ("cross", [10.0])]
    assert list(plans.vis_products(vis, autos=False)) == ["cross"]
    cal = spark.createDataFrame([(1, "Jee", 3.0, 4.0, 7.0)], "ant int, antpol string, gain_re double, gain_im double, chisq double")
    got = plans.cal_products(cal, "omni")
    assert {n: (p.data.first().v, p.kind) for n, p in got.items()} == {"omni_gain": (5.0, "filter"), "omni_chisq": (7.0, "chisq")}


def test_shares_go_onto_every_baseline(spark):
    rng = np.random.default_rng(5)
    rows, base = [], {}
    for b in range(4):
        f = rng.random((5, 6)) < 0.2
        f[2, 3] |= b < 3
        f[:, 5] |= b > 0
        base[b] = f
        rows += [(b, b + 1, "ee", t, c, bool(f[t, c])) for t in range(5) for c in range(6)]
    vis = spark.createDataFrame(rows, "ant1 int, ant2 int, pol string, time_idx int, chan int, flag boolean")
    v = np.sqrt(np.mean([f.astype(float) for f in base.values()], 0))
    wide = (v >= 0.8) | (np.sqrt((v**2).mean(0)) >= 0.7)[None, :] | (np.sqrt((v**2).mean(1)) >= 0.75)[:, None]
    got = plans.h1c_apply(vis, [plans.share_waterfall(vis, 0.8, 0.7, 0.75)], [4])
    for r in got.collect():
        assert r.flag == (r.ant2 == 4 or base[r.ant1][r.time_idx, r.chan] or wide[r.time_idx, r.chan])
    x = np.random.default_rng(6).normal(size=(2, 8, 9)) + 20
    x[:, 4, 4] += 90
    t, f = np.indices((8, 9))
    parts = [pd.DataFrame({"ant1": b, "ant2": 7, "pol": "ee", "time_idx": t.ravel(), "chan": f.ravel(), "v": x[b].ravel()}) for b in (0, 1)]
    out = plans.h1c_run(spark.createDataFrame(pd.concat(parts)), kt=2, kf=2)
    assert {(r.time_idx, r.chan) for r in out["vis_waterfall"].where("flag and v = 1").collect()} == {(4, 4)}

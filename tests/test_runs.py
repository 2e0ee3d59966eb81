from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from arraylens.operators import classify, flags, kernels, reduce
from arraylens.plans import runs
from arraylens.streaming.live import live_power


def frame(spark, x, name="v", **more):
    t, f = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"time_idx": t.ravel().astype("int32"), "chan": f.ravel().astype("int32"), name: x.ravel(), **more}))


def test_closed_forms():
    ramp = np.tile(np.arange(100.0), (100, 1))
    assert kernels.medmin(ramp) == 99
    assert np.allclose(kernels.medmin_filter(ramp), np.minimum(np.arange(100) + 7, 99)[None, :])
    i, j = np.indices((100, 100)).astype(float)
    assert np.allclose(kernels.detrend_deriv(j * i**2 + j**3), 1)
    assert kernels.watershed(np.array([2, 2, 5, 0, 2, 0, 5.0]), np.array([0, 0, 1, 0, 0, 0, 1]) > 0, 2).tolist() == [True, True, True, False, False, False, True]
    with pytest.raises(ValueError):
        kernels.clamp(0, 5)
    with pytest.raises(KeyError):
        kernels.xrfi_waterfall(ramp, algorithm="nothing")


def test_a_spike_is_flagged_and_its_neighbour_grows():
    rng = np.random.default_rng(0)
    x = 100 + rng.normal(size=(20, 20))
    x[3, 3] += 100
    x[3, 4] += 4
    got = kernels.xrfi_waterfall(x)
    assert got[3, 3] and got.sum() <= 3


def test_antenna_search_finds_dead_and_crossed(spark):
    rows = []
    for a in range(8):
        for b in range(8):
            if a != b:
                for p in ("ee", "nn", "en", "ne"):
                    c = 0.9 if p in ("ee", "nn") else 0.1
                    if 5 in (a, b):
                        c = 0.1 if p in ("ee", "nn") else 0.9
                    if 2 in (a, b) and p == "ee":
                        c = 0.0
                    rows.append((p, a, b, c))
    from arraylens.operators.iterate import antenna_search

    out, metrics = antenna_search(spark.createDataFrame(rows, "pol string, ant1 int, ant2 int, corr double"))
    assert {(r.ant, r.antpol, r.reason) for r in out.collect()} == {(2, "Jee", "dead"), (5, "Jee", "crossed"), (5, "Jnn", "crossed")}
    assert metrics.count() > 0


def test_corr_stats(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(5, 3)) + 1j * rng.normal(size=(5, 3))
    t, f = np.indices(z.shape)
    df = spark.createDataFrame(pd.DataFrame({"ant1": 0, "ant2": 1, "pol": "ee", "time_idx": t.ravel(), "chan": f.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()}))
    p = z[0:4:2] * np.conj(z[1:5:2])
    got = reduce.corr_stats_interleaved(df).collect()[0].corr
    assert abs(got - abs(np.mean(p / abs(p)))) < 1e-12


def test_xrfi_recovers_injected_interference(spark):
    rng = np.random.default_rng(2)
    data = []
    for a in range(3):
        x = 100 + rng.normal(size=(24, 32))
        x[:, 7] += 40
        x[11, :] += 30
        t, f = np.indices(x.shape)
        data.append(pd.DataFrame({"ant": a, "time_idx": t.ravel(), "chan": f.ravel(), "v": x.ravel()}))
    df = spark.createDataFrame(pd.concat(data))
    got = runs.xrfi({"auto": (df, ["ant"])}, kt=4, kf=4)["flags"].toPandas()
    flag = got.pivot(index="time_idx", columns="chan", values="flag").to_numpy()
    assert flag[:, 7].mean() > 0.9 and flag[11].mean() > 0.9
    assert np.delete(np.delete(flag, 7, 1), 11, 0).mean() < 0.1


def test_classes_add(spark):
    def c(rows):
        return classify.AntennaClassification(spark.createDataFrame(rows, "ant int, antpol string, class string"))

    s = c([(0, "Jee", "good"), (1, "Jee", "good"), (2, "Jee", "suspect")]) + c([(0, "Jee", "bad"), (1, "Jee", "good"), (2, "Jee", "suspect"), (3, "Jnn", "good")])
    assert [s[(i, "Jee")] for i in range(3)] == ["bad", "good", "suspect"] and s.is_good((3, "Jnn"))
    with pytest.raises(TypeError):
        s + 1
    with pytest.raises(ValueError):
        s[(1, "ee")]


def test_a_priori(spark):
    spec = {"channel_flags": [1, [3, 4]], "LST_flags": [[23.0, 1.0]], "ex_ants": [4, [2, "Jee"]]}
    freqs = spark.createDataFrame([(i, 1e8 + i) for i in range(6)], "chan int, freq_hz double")
    assert sorted(r.chan for r in flags.a_priori_channels(spec, freqs).collect()) == [1, 3, 4]
    times = spark.createDataFrame([(0, 0.0, 23.5), (1, 0.1, 0.5), (2, 0.2, 2.0)], "time_idx int, jd double, lst_hr double")
    assert sorted(r.time_idx for r in flags.a_priori_times(spec, times).collect()) == [0, 1]
    assert flags.a_priori_antennas(spec, indices_only=True) == [2, 4]
    assert flags.a_priori_antennas(spec, by_ant_pol=True, ant_pols=["Jee", "Jnn"]) == [(2, "Jee"), (4, "Jee"), (4, "Jnn")]
    with pytest.raises(TypeError):
        flags.a_priori_channels({"channel_flags": ["x"]}, freqs)
    with pytest.raises(ValueError):
        flags.a_priori_channels({"channel_flags": [[4, 3]]}, freqs)


def test_live_power(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s), 0, "ee", float(s)) for s in range(0, 60, 10)]
    spark.createDataFrame(rows, "ts timestamp, ant int, pol string, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, ant int, pol string, v double").parquet(str(tmp_path / "in"))
    q = live_power(s).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.power, r.n) for r in spark.sql("select * from live").collect()] == [(25.0, 6)]


def test_modz_search_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    s = 10 + rng.normal(0, 0.1, (9, 12))
    s[4] += np.linspace(0, 9, 12)
    s[7] += 2.0
    rows = [(a, "ee", c, float(s[a, c])) for a in range(9) for c in range(12)]
    from arraylens.operators.iterate import modz_search

    got, scores = modz_search(spark.createDataFrame(rows, "ant int, pol string, chan int, s double"), cut=6.0)
    out = []
    while True:
        kept = [a for a in range(9) if a not in out]
        d = np.median(np.abs(s - np.median(s[kept], 0)), 1)
        z = (d - np.median(d[kept])) / np.median(np.abs(d[kept] - np.median(d[kept]))) / reduce.MAD_AUTO
        worst = max(kept, key=lambda a: z[a])
        if z[worst] <= 6.0:
            break
        out.append(worst)
    assert got == sorted(out) and {4, 7} <= set(got)
    assert np.allclose([r.z for r in scores.orderBy("ant").collect()], z)


def test_auto_rfi_finds_the_planted_antenna(spark):
    rng = np.random.default_rng(7)
    band = 100 + 20 * np.sin(np.linspace(0, 2, 60))
    parts = []
    for a in range(6):
        x = band * (1 + rng.normal(0, 0.005, (8, 60)))
        x[2:5, 40] *= 3  # seen by all antennas
        if a == 2:
            x[:, 20] *= 1.5
        if a == 5:
            x[:] = rng.random((8, 60)) * 1000
        t, f = np.indices(x.shape)
        parts.append(pd.DataFrame({"ant": a, "pol": "ee", "time_idx": t.ravel().astype("int32"), "chan": f.ravel().astype("int32"), "v": x.ravel()}))
    autos = spark.createDataFrame(pd.concat(parts))
    classes, shares = runs.auto_rfi_class(autos, [100e6 + 1e5 * i for i in range(60)], 40_000.0, bad=[5], suspect=(0.01, 0.015), nsig=6.0)
    assert {r.ant: r["class"] for r in classes.collect()} == {0: "good", 1: "good", 2: "bad", 3: "good", 4: "good"}
    assert abs({r.ant: r.value for r in shares.collect()}[2] - 1 / 60) < 0.01


def test_day_threshold_takes_infinite_metrics_from_the_first_round(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(12, 14)), rng.normal(size=(12, 14))
    x[:, 5] = np.inf
    y[:, 5] += 60
    x[8] += 60
    make = lambda z: frame(spark, z).selectExpr("'auto' AS product", "time_idx", "chan", "v")
    got = {(r.time_idx, r.chan) for r in runs.day_threshold(make(x), make(y)).where("flag").collect()}
    assert got == {(t, c) for t in range(12) for c in range(14) if c == 5 or t == 8}


def test_firstcal_metrics_and_drift(spark):
    rng = np.random.default_rng(4)
    freq = 100e6 + 1e5 * np.arange(16)
    rows = []
    for a in range(4):
        for t in range(40):
            delay = 50e-9 + 2e-9 * np.sin(t / 8) + 1e-11 * rng.normal() * (400 if a == 3 else 1)
            g = np.exp(2j * np.pi * freq * delay)
            rows += [(a, "Jee", t, c, float(freq[c]), float(g[c].real), float(g[c].imag)) for c in range(16)]
    gains = spark.createDataFrame(rows, "ant int, antpol string, time_idx int, chan int, freq_hz double, gain_re double, gain_im double")
    rough, smooth = (runs.firstcal_metrics(gains, 0.5, smooth=s) for s in (False, True))
    wide, narrow = ({r.ant: r.ant_std for r in x["ants"].collect()} for x in (rough, smooth))
    assert all(narrow[a] < 0.2 < 1.0 < wide[a] for a in range(3)) and narrow[3] > 0.5
    assert {r.ant: r.bad for r in smooth["ants"].collect()} == {0: False, 1: False, 2: False, 3: True}


def test_metrics_of_observations_are_those_of_runs_apart(spark):
    rng = np.random.default_rng(6)
    freq = 100e6 + 1e5 * np.arange(12)
    rows = []
    for obs in ("a", "b"):
        for a in range(4):
            for t in range(15):
                g = np.exp(2j * np.pi * freq * (40e-9 + 1e-9 * rng.normal() * (a + 1) * (5 if obs == "b" else 1)))
                rows += [(obs, a, "Jee", t, c, float(freq[c]), float(g[c].real), float(g[c].imag), float(abs(rng.normal()))) for c in range(12)]
    cal = spark.createDataFrame(rows, "obs string, ant int, antpol string, time_idx int, chan int, freq_hz double, gain_re double, gain_im double, chisq double")

    def apart(make, name, key, value):
        both = {(r.obs, *[r[k] for k in key]): r[value] for r in make(cal, ("obs",))[name].collect()}
        one = {(o, *[r[k] for k in key]): r[value] for o in ("a", "b") for r in make(cal.where(f"obs = '{o}'").drop("obs"), ())[name].collect()}
        assert both.keys() == one.keys() and all(np.isclose(both[k], one[k]) for k in one), (name, value)

    def first(c, each):
        return runs.firstcal_metrics(c, each=each)

    def omni(c, each):
        return runs.omnical_metrics(c, each=each)

    for name, key, value in (("ants", ["ant"], "ant_std"), ("ants", ["ant"], "ant_z"), ("times", ["time_idx"], "time_std"), ("all", [], "max_std"), ("all", [], "good")):
        apart(first, name, key, value)
    for value in ("chisq_std", "z", "max_z", "tot_avg"):
        apart(omni, "chisq", ["ant"], value)
    apart(omni, "chisq_time", ["time_idx"], "chisq_avg")


def test_array_view_lists_weak_antennas(spark):
    from arraylens.plans import plots

    rows = [(a, "ee", t, c, {0: 10.0, 1: 1e-4, 2: 5.0}[a]) for a in range(3) for t in range(3) for c in range(4)]
    autos = spark.createDataFrame(rows, "ant int, pol string, time_idx int, chan int, v double")
    ants = spark.createDataFrame([(0, 0.0, 0.0, 1, True), (1, 1.0, 0.0, 1, True), (2, 2.0, 0.0, 2, False), (3, 3.0, 0.0, 2, True)], "ant int, x double, y double, receiver int, connected boolean")
    view = plots.array_view(autos, ants)
    assert {r.ant: None if r.value is None else round(r.value, 6) for r in view.collect()} == {0: 10.0, 1: -40.0, 2: 6.9897, 3: None}
    assert [(r.ant, r.value) for r in plots.weak_antennas(view).collect()] == [(1, -40.0)]
    got = {(r.receiver, r.ant, r.block): (r.bin, r.n) for r in plots.rms_histogram(autos, ants, 2).collect()}
    edges = np.linspace(-2, 4, 24)
    for a, v in ((0, 10.0), (2, 5.0)):
        want = int(np.flatnonzero(np.histogram(np.log2(np.sqrt(v / 2)), edges)[0])[0])
        assert got[1 if a == 0 else 2, a, 0] == got[1 if a == 0 else 2, a, 1] == (want, 6)
    assert len(got) == 4

"""Kernels against planted cases and plain versions."""

from collections import defaultdict

import numpy as np
import pytest

from arraylens.operators import flags, kernels
from arraylens.operators.iterate import blame


@pytest.mark.parametrize("sign", [1, -1])
def test_simple_flags_find_low_and_high_outliers(sign):
    x = np.random.default_rng(3).normal(size=(40, 40))
    x[10, 12] += sign * 100
    x[:, 25] += sign * 30
    x[30, :] += sign * 30
    found = kernels.simple_flag_waterfall(x, 8, 8)
    assert found[10, 12] and found[:, 25].all() and found[30].all() and found.mean() < 0.15


@pytest.mark.parametrize("sign", [1, -1])
def test_threshold_waterfall_finds_low_and_high(spark, sign):
    x = np.random.default_rng(5).normal(size=(30, 20))
    x[:, 7] += sign * 40
    x[11] += sign * 40
    rows = [(t, c, float(x[t, c])) for t in range(30) for c in range(20)]
    got = flags.threshold_waterfall(spark.createDataFrame(rows, "time_idx int, chan int, v double")).where("flag").collect()
    assert {(r.time_idx, r.chan) for r in got} >= {(11, c) for c in range(20)} | {(t, 7) for t in range(30)}


def test_gaps_of_equal_length_go_from_the_last():
    f = np.zeros(30, bool)
    f[8:12] = f[20:24] = True
    got = kernels.max_gap(f, 3)
    # the later gap first: 16 unflagged before, 6 after; then the earlier one: 8 each, the side before goes
    want = f.copy()
    want[24:] = True
    want[:8] = True
    assert (got == want).all()


def test_whole_stretches_that_never_return_are_flagged():
    metric = np.r_[np.zeros(60), np.full(60, 10.0), np.zeros(60)]
    start = np.zeros(180, bool)
    start[62:70] = start[110:118] = True
    got = kernels.convolution_flagging(metric, start, (-1, 3), sigma=2, longest=200)
    assert got[70:110].all() and not got[:60].any() and not got[121:].any()
    none = kernels.convolution_flagging(np.zeros(50), np.zeros(50, bool), (-1, 1), 5)
    assert not none.any()


def test_smooth_against_sums():
    x = np.random.default_rng(1).normal(size=11)
    mirror = lambda i: -1 - i if i < 0 else 21 - i if i > 10 else i
    w = {d: np.exp(-(d**2) / 18) for d in range(-5, 7)}
    want = [sum(v * x[mirror(i + d)] for d, v in w.items()) / sum(w.values()) for i in range(11)]
    assert np.allclose(kernels.gauss_smooth(x, 3), want)


def test_smooth_model_flags_only_what_is_above():
    f = np.linspace(100e6, 110e6, 40)
    x = np.full((4, 40), 100.0)
    x[1, 10], x[2, 20] = 200, 20
    got = kernels.dpss_flagger(x, np.full(x.shape, 1.0), f, [0.0], [1e-7], nsig=6, cutoffs=[1e-9])
    assert got[1, 10] and not got[2, 20]


def test_phase_spectrum_against_sums():
    rng = np.random.default_rng(2)
    g = rng.normal(size=(5, 8)) + 1j * rng.normal(size=(5, 8))
    k, n = np.arange(8)[:, None], np.arange(8)[None]
    t = g @ np.exp(-2j * np.pi * k * n / 8)
    t = np.concatenate([t[:, 4:], t[:, :4]], axis=1)
    assert np.allclose(kernels.phase_spectrum(g), np.hypot(np.median(t.real, 0), np.median(t.imag, 0)))


def test_blame_against_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    rows = [(a, "Jee", b, "Jee", int(rng.integers(0, 9))) for a in range(8) for b in range(a + 1, 8)]
    total = defaultdict(int)
    for a, _, b, _, n in rows:
        total[a] += n
        total[b] += n
    left, want = list(rows), {}
    for a in sorted(total, key=lambda x: (-total[x], x)):
        own = [r for r in left if a in (r[0], r[2])]
        want[a] = max((r[4] for r in own), default=0)
        left = [r for r in left if r not in own]
    got = {r.ant: r.n for r in blame(spark.createDataFrame(rows, "ant1 int, antpol1 string, ant2 int, antpol2 string, n int")).collect()}
    assert got == want


def test_feeds_are_flagged_on_their_own(spark):
    rows = [(5, 6, p, False) for p in ("ee", "nn", "en", "ne")] + [(4, 5, "ne", False)]
    got = flags.flag_antennas(spark.createDataFrame(rows, "ant1 int, ant2 int, pol string, flag boolean"), [(5, "Jee")]).collect()
    assert {(r.ant1, r.ant2, r.pol): r.flag for r in got} == {(5, 6, "ee"): True, (5, 6, "nn"): False, (5, 6, "en"): True, (5, 6, "ne"): False, (4, 5, "ne"): True}
    autos = spark.createDataFrame([(5, "Jee", False), (5, "Jnn", False), (2, "Jnn", False)], "ant int, antpol string, flag boolean")
    assert [r.flag for r in flags.flag_antennas(autos, [2, (5, "Jnn")]).orderBy("ant", "antpol").collect()] == [True, False, True]


def test_fitted_gaussian_process():
    """The fit is at the top of a dense grid of likelihoods and near what was planted."""
    rng = np.random.default_rng(4)
    t = np.sort(rng.random(150))
    gap = (t[:, None] - t[None, :]) ** 2
    y = np.linalg.cholesky(np.exp(-gap / (2 * 0.1**2)) + 0.05 * np.eye(150)) @ rng.normal(size=150)
    length, noise = kernels.gp_fit(t, y)
    grid = min(kernels.gp_likelihood(np.log([a, b]), gap, y)[0] for a in np.geomspace(0.01, 1, 30) for b in np.geomspace(1e-3, 10, 30))
    best, slope = kernels.gp_likelihood(np.log([length, noise]), gap, y)
    assert best <= grid + 1e-9 and np.abs(slope).max() < 1e-3
    assert 0.06 < length < 0.16 and 0.03 < noise < 0.08
    for i in range(2):  # the gradient is the slope of the likelihood
        p = np.log([0.07, 0.3])
        d = np.eye(2)[i] * 1e-5
        up, down = (kernels.gp_likelihood(p + s * d, gap, y)[0] for s in (1, -1))
        assert np.isclose((up - down) / 2e-5, kernels.gp_likelihood(p, gap, y)[1][i], rtol=1e-4)


def test_gaussian_process_follows_the_slow_part():
    rng = np.random.default_rng(9)
    t = np.linspace(0, 1, 120)
    slow, fast = 3 * np.sin(5 * t), rng.normal(0, 0.1, 120)
    y = slow + fast
    y[7] = np.nan
    got = kernels.gp_smooth(t, y)
    assert np.isfinite(got).all() and np.abs(got - slow).max() < 0.2
    assert kernels.gp_smooth(t, np.zeros(120)).tolist() == [0.0] * 120
    assert kernels.gp_smooth(t[:1], y[:1]).tolist() == [0.0]

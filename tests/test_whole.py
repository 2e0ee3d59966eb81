"""Array queries read all of their tables, held against brute force on small ones."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from arraylens.operators import calibration
from arraylens.plans.queries import QUERIES
from arraylens.sources import adaptors

#: Integrations of the labels.
LENGTHS = {0: 31, 1: 20, 7: 25}


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """(folder, label -> complex spectra), with more integrations than 12."""
    rng, at = np.random.default_rng(5), tmp_path_factory.mktemp("whole")
    x = {k: rng.normal(size=(n, 64)) for k, n in LENGTHS.items()}
    rows = [(100 * i + k, k, [float(v) for v in row]) for k, m in x.items() for i, row in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at), {k: m + 1j * m[:, ::-1] for k, m in x.items()}


def baselines(z):
    """(ant1, ant2, pol) -> visibilities by integration and channel."""
    out = {}
    for a in z:
        for b in z:
            if a < b:
                n = min(len(z[a]), len(z[b]))
                v = z[a][:n] * z[b][:n].conj()
                out |= {(a, b, p): v[:, 16 * i : 16 * i + 16] for i, p in enumerate(("ee", "nn", "en", "ne"))}
    return out


def same(got, want):
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


def test_correlations_use_all_integrations(spark, vectors):
    at, z = vectors
    inter, sumdiff = {}, {}
    for k, v in baselines(z).items():
        n = len(v) // 2 * 2
        even, odd = v[0:n:2], v[1:n:2]
        for out, p in ((inter, even * odd.conj()), (sumdiff, (even + odd) * (even - odd).conj())):
            out[k] = abs((p / abs(p)).mean())
    key = lambda r: (r.ant1, r.ant2, r.pol)
    same({key(r): r.corr for r in QUERIES["corr_stats_interleaved_all"](spark, at).collect()}, inter)
    same({key(r): r.corr for r in QUERIES["corr_stats_sumdiff_all"](spark, at).collect()}, sumdiff)
    per = {(a, p): np.mean([c for k, c in inter.items() if a in k[:2] and k[2] == p]) for a in z for p in ("ee", "nn")}
    same({(r.ant, r.pol): r.corr for r in QUERIES["corr_per_ant_all"](spark, at).collect()}, per)
    zeros = {k: (abs(v.real) < 0.002).sum(1).max() for k, v in baselines(z).items()}
    same({key(r): r.n for r in QUERIES["even_odd_zero_counts_all"](spark, at).collect()}, zeros)


def test_searches_use_all_integrations(spark, tmp_path):
    """Labels that agree in their first 12 integrations only do not correlate, and zeros after those count."""
    rng = np.random.default_rng(6)
    start, zero = np.tile(np.abs(rng.normal(size=64)) + 1, (12, 1)), np.zeros((1, 64))
    rows = [(10 * i + k, k, [float(v) for v in row]) for k in (0, 1) for i, row in enumerate(np.vstack([start, rng.normal(size=(180, 64)), zero]))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["ant_iterative"](spark, str(tmp_path)).count() > 0
    assert "bad" in {r["class"] for r in QUERIES["even_odd_zero_blame"](spark, str(tmp_path)).collect()}


def test_covariances_of_all_pairs(spark, vectors):
    at, z = vectors
    cov, corr = {}, {}
    for a in z:
        for b in z:
            n = min(len(z[a]), len(z[b]))
            x, y = z[a][:n].ravel(), z[b][:n].ravel()
            cov[a, b] = (x * y.conj()).mean() - x.mean() * y.mean().conj()
            corr[a, b] = cov[a, b] / (x.std() * y.std())
    for name, want in (("bl_cov_all", cov), ("bl_corr_all", corr)):
        same({(r.b1, r.b2): complex(r.re, r.im) for r in QUERIES[name](spark, at).collect()}, want)


def test_delay_scatter_is_of_fitted_delays(spark, vectors):
    at, z = vectors
    want = {}
    for a, m in z.items():
        d = np.median(np.diff(np.unwrap(np.angle(m)), axis=1) / 1e6, axis=1) / (-2 * np.pi) * 1e9
        v = d - np.median(d)
        dev = v - np.median(v)
        u = (dev / (9 * np.median(abs(dev)))) ** 2
        dev, u = dev[u < 1], u[u < 1]
        want[a] = np.median(d), np.sqrt(len(v) * (dev**2 * (1 - u) ** 4).sum() / ((1 - u) * (1 - 5 * u)).sum() ** 2)
    same({r.ant: (r.ant_avg, r.ant_std) for r in QUERIES["delay_std_fitted"](spark, at).collect()}, want)


def scatter(x):
    """The square root of the biweight midvariance."""
    dev = x - np.median(x)
    mad = np.median(abs(dev))
    u = (dev / (9 * mad)) ** 2 if mad else np.ones(len(x))
    dev, u = dev[u < 1], u[u < 1]
    return np.sqrt(len(x) * (dev**2 * (1 - u) ** 4).sum() / ((1 - u) * (1 - 5 * u)).sum() ** 2) if mad else 0.0


def test_delay_std_has_all_its_scatters_and_scores(spark, vectors):
    """By antenna, by integration and in all; labels have 31, 20 and 25 integrations."""
    at, z = vectors
    delay = {a: np.median(np.diff(np.unwrap(np.angle(m)), axis=1) / 1e6, axis=1) / (-2 * np.pi) * 1e9 for a, m in z.items()}
    fluct = {a: d - np.median(d) for a, d in delay.items()}
    whole, ant = scatter(np.concatenate([*fluct.values()])), {a: scatter(v) for a, v in fluct.items()}
    time = [scatter(np.array([v[t] for v in fluct.values() if t < len(v)])) for t in range(31)]
    want = {
        (a, t): (np.median(delay[a]), ant[a], time[t], whole, max(ant.values()), x / whole, np.median(abs(v / whole))) for a, v in fluct.items() for t, x in enumerate(v)
    }
    rows = QUERIES["delay_std"](spark, at).collect()
    assert len(rows) == len(want)
    same({(r.ant, r.time_idx): (r.ant_avg, r.ant_std, r.time_std, r.agg_std, r.max_std, r.z, r.ant_z) for r in rows}, want)


def test_delays_without_scatter_or_samples(spark, tmp_path):
    """A whole without scatter gives scores of NaN; a vector without samples has no row."""
    rows = [(10 * i + k, k, [1.0, 2.0] * 32) for k in (0, 1) for i in range(5)] + [(90, 0, [None] * 64), (91, 1, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["delay_std"](spark, str(tmp_path)).collect()
    assert sorted((r.ant, r.time_idx) for r in got) == [(k, t) for k in (0, 1) for t in range(5)]
    assert all((r.ant_std, r.time_std, r.agg_std, r.max_std) == (0, 0, 0, 0) and np.isnan(r.z) and np.isnan(r.ant_z) for r in got)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_dealt_medians_are_exact(spark, by):
    rng = np.random.default_rng(12)
    values = {"even": rng.standard_cauchy(20_000), "odd": 1e12 + rng.normal(size=20_001), "ties": rng.integers(0, 5, 7001) * 1.0, "halves": np.repeat([1.0, 2.0], 3000), "one": np.array([3.0])}
    for names in [[*values]] if by else [[k] for k in values]:
        rows = [(k, float(x), 5) for k in names for x in values[k]] + [(k, None, 5) for k in [*names, "none"]]
        df = spark.createDataFrame(rows, "k string, v double, c int").repartition(13)
        want = df.groupBy(*by).agg(F.median("v").alias("median"), F.first("c").alias("c"))
        assert sorted(calibration.dealt_median(df, by, "v", keep=["c"]).collect()) == sorted(want.collect())
        plain, dealt = ({tuple(r)[:-2]: tuple(r)[-2:] for r in make(df, by).collect()} for make in (calibration.biweight, calibration.dealt_biweight))
        assert plain.keys() == dealt.keys()
        assert all(x == y or abs(x - y) < 1e-9 * abs(y) for k in plain for x, y in zip(dealt[k], plain[k], strict=True))


GRID = "detrend_deriv detrend_medfilt detrend_meanfilt detrend_medminfilt channel_diff_flags xrfi_waterfall simple_flag_waterfall dpss_flags".split()


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """Events from 29 December to 4 February, with a spike on the last day."""
    at, rng, n = tmp_path_factory.mktemp("days"), np.random.default_rng(7), 38
    rows = [(24 * d + h, 0, datetime(2023, 12, 29) + timedelta(days=d, hours=h), 900.0 if (d, h) == (n - 1, 12) else float(rng.normal(50, 1))) for d in range(n) for h in range(24)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{at}/events.parquet")
    return str(at)


@pytest.mark.parametrize("name", GRID)
def test_grids_have_all_days(spark, days, name):
    rows = QUERIES[name](spark, days).collect()
    assert {r.time_idx for r in rows} == set(range(-3, 35))
    spike = next(r for r in rows if (r.time_idx, r.chan) == (34, 12))
    if name in ("detrend_medfilt", "detrend_meanfilt", "xrfi_waterfall"):
        assert spike.flag if "flag" in spike else abs(spike.z) > 3  # the mirrored spike is 2 of 25 samples: 3.5 at most by means


def test_filters_read_their_table_once(spark):
    """The grid reads the events twice, for its days and its samples, and the filters on it no further."""
    for name in ("detrend_meanfilt", "channel_diff_flags", "detrend_deriv"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 2, name


def test_labels_are_numbered_over_ranges_of_ids(spark, tmp_path):
    """No task numbers all rows of a label; rows without label or id have their place too."""
    rng = np.random.default_rng(9)
    ids = [*rng.permutation(np.arange(-3, 40) * 1000).tolist(), 2**62]
    rows = [(int(i), k, [float(i)] * 64) for k in (0, 1, None) for i in ids[: 44 if k != 1 else 7]] + [(None, 0, [0.5] * 64)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in adaptors.numbered(spark, str(tmp_path)).collect():
        got.setdefault(r.label, []).append((r.time_idx, r.embedding[0]))
    want = {}
    for i, k, x in sorted(rows, key=lambda r: -np.inf if r[0] is None else r[0]):
        want.setdefault(k, []).append(np.float32(x[0]))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == want
    assert all(sorted(t for t, _ in v) == list(range(len(v))) for v in got.values())
    plan = QUERIES["delay_std"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [row_number" in line and "[label#" in line]


def test_delays_are_fitted_in_as_many_tasks_as_asked_for(spark, vectors):
    """The spectra of one antenna are dealt over tasks, and no scatter over all antennas is made for delay_std."""
    plan = QUERIES["delay_std"](spark, vectors[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [ant#" in plan
    assert "Aggregate [percentile" not in plan

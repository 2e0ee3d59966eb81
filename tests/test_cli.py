"""The command line over small tables."""

import numpy as np
import pytest

from arraylens import schema
from arraylens.plans import cli
from arraylens.sources import tables


@pytest.fixture(scope="module")
def night(spark, tmp_path_factory):
    """Folder with visibilities and solutions of two observations, interference at (6, 4), and antennas."""
    at, rng = tmp_path_factory.mktemp("cli"), np.random.default_rng(2)
    vis, cal = [], []
    for t in range(12):
        obs, jd = f"zen.{t // 6}", 2458043.1 + t / 1000
        for c in range(9):
            extra = 500.0 if (t, c) == (6, 4) else 0.0
            for a, b in ((0, 0), (0, 1), (1, 1)):
                vis.append((obs, t % 6, jd, 1.0, c, 1e8 + 1e5 * c, a, b, "ee", float(50 + rng.normal() + extra), float(rng.normal()), False, 1.0, 10.0, 1e5))
            for a in (0, 1):
                cal.append((obs, t % 6, jd, c, 1e8 + 1e5 * c, a, "Jee", float(1 + 0.01 * rng.normal()), 0.0, float(1 + 0.1 * rng.normal() + extra), 0.0, False))
    spark.createDataFrame(vis, schema.VIS).write.parquet(f"{at}/vis")
    spark.createDataFrame(cal, schema.CAL).write.parquet(f"{at}/cal")
    spark.createDataFrame([(0, 0.0, 0.0, 1, True), (1, 9.0, 0.0, 1, True)], "ant int, x double, y double, receiver int, connected boolean").write.parquet(f"{at}/ants")
    return str(at)


def test_a_night_with_solutions(spark, night):
    cli.main(["night_xrfi", "--out", f"{night}/out", "--vis", f"{night}/vis", "--cal", f"{night}/cal", "--Kt", "1", "--Kf", "1", "--keep_edges", "--sig_init_mean", "9", "--sig_adj_mean", "9"])
    flags = tables.read_table(spark, f"{night}/out/flags")
    assert flags.count() == 12 * 9 and flags.where("time_idx = 6 and chan = 4 and flag and night = 2458043").count() == 1
    got = tables.read_table(spark, f"{night}/out/cal").where("time_idx = 6 and chan = 4").collect()
    assert len(got) == 2 and all(r.flag and r.gain_re == 1.0 for r in got)
    products = {r.product for r in tables.read_table(spark, f"{night}/out/metrics1").select("product").distinct().collect()}
    assert products == {"auto", "cross", "cal_gain", "cal_chisq", "combined"}


def test_views_and_options(spark, night):
    cli.main(["array_view", "--out", f"{night}/view", "--autos", f"{night}/vis", "--ants", f"{night}/ants", "--linear"])
    assert tables.read_table(spark, f"{night}/view/view").count() == 2
    assert tables.read_table(spark, f"{night}/view/weak").count() == 0
    for name in cli.RUNS:
        assert cli.parser().parse_args([name, "--out", "x"]).run == name
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing", "--out", "x"])

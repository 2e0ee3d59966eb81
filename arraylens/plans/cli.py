"""Command line: one sub-command for each run, over Parquet tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arraylens.operators import flags, nights
from arraylens.plans import nights as night_plans
from arraylens.plans import plots, runs
from arraylens.sources import tables

#: Options of each run with their defaults; a bool is a switch.
RUNS = {
    "ant_metrics": {"sums": "", "diffs": "", "cross_cut": 0.0, "dead_cut": 0.4},
    "auto_metrics": {"autos": "", "edge_cut": 100, "median_cut": 8.0, "mean_cut": 4.0, "Kt": 8, "Kf": 8, "sig_init": 5.0, "sig_adj": 2.0, "chan_thresh_frac": 0.05, "ex_ants": ""},
    "firstcal_metrics": {"cal": "", "std_cut": 0.5, "smooth": False},
    "omnical_metrics": {"cal": "", "firstcal": "", "edge": 0, "phs_std_cut": 0.3, "chisq_std_zscore_cut": 4.0},
    "xrfi": {"vis": "", "a_priori": "", "Kt": 8, "Kf": 8, "sig_init_med": 10.0, "sig_adj_med": 4.0, "sig_init_mean": 5.0, "sig_adj_mean": 2.0, "ex_ants": ""},
    "day_threshold": {"first": "", "second": "", "nsig_f": 7.0, "nsig_t": 7.0, "nsig_f_adj": 3.0, "nsig_t_adj": 3.0},
    "apply_flags": {"vis": "", "flags": "", "ex_ants": ""},
    "night_xrfi": {"vis": "", "cal": "", "Kt": 8, "Kf": 8, "sig_init_med": 10.0, "sig_adj_med": 4.0, "sig_init_mean": 5.0, "sig_adj_mean": 2.0, "ex_ants": "", "keep_edges": False},
    "h1c_run": {"vis": "", "cal": "", "Kt": 8, "Kf": 8, "sig_init": 6.0, "sig_adj": 2.0, "px_threshold": 0.2, "freq_threshold": 0.5, "time_threshold": 0.05, "ex_ants": ""},
    "auto_rfi": {"autos": "", "int_count": 1.0, "nsig": 6.0, "flag_broadcast_thresh": 0.5, "ex_ants": ""},
    "array_view": {"autos": "", "ants": "", "linear": False},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arraylens")
    subs = top.add_subparsers(dest="run", required=True)
    for name, options in RUNS.items():
        p = subs.add_parser(name)
        p.add_argument("--out", required=True)
        p.add_argument("--overwrite", action="store_true")
        for k, v in options.items():
            if isinstance(v, bool):
                p.add_argument(f"--{k}", action="store_true")
            else:
                p.add_argument(f"--{k}", type=type(v), default=v)
    return top


def main(args: Sequence[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.getOrCreate()

    def put(df, name: str) -> None:
        tables.write_table(df, f"{a.out.rstrip('/')}/{name}", overwrite=a.overwrite, history=f"arraylens {a.run}")

    def paths(text: str) -> list[str]:
        return [p for p in text.split(",") if p]

    if a.run == "ant_metrics":
        total = tables.read_vis(spark, *paths(a.sums))
        diff = tables.read_vis(spark, *paths(a.diffs)) if a.diffs else None
        excluded, metrics = runs.ant_metrics(total, diff, a.cross_cut, a.dead_cut)
        put(excluded, "ex_ants")
        put(metrics, "ant_metric")
    elif a.run == "auto_metrics":
        autos = tables.read_autos(spark, *paths(a.autos))
        prior = flags.ex_antennas(spark, a.ex_ants)
        how = dict(kt=a.Kt, kf=a.Kf, first=a.sig_init, next_to=a.sig_adj, share=a.chan_thresh_frac)
        got = runs.auto_metrics(autos, (a.median_cut, a.mean_cut), a.edge_cut, prior, **how)
        put(spark.createDataFrame([(x,) for x in got["round2"]], "ant int"), "ex_ants")
        put(got["flags"], "flags")
    elif a.run == "firstcal_metrics":
        for k, df in runs.firstcal_metrics(tables.read_cal(spark, *paths(a.cal)), a.std_cut, smooth=a.smooth).items():
            put(df, k)
    elif a.run == "omnical_metrics":
        first = tables.read_cal(spark, *paths(a.firstcal)) if a.firstcal else None
        for k, df in runs.omnical_metrics(tables.read_cal(spark, *paths(a.cal)), first, a.edge, None, a.phs_std_cut, a.chisq_std_zscore_cut).items():
            put(df, k)
    elif a.run == "xrfi":
        vis = flags.flag_antennas(tables.read_vis(spark, *paths(a.vis)), flags.ex_antennas(spark, a.ex_ants)).where("NOT flag")
        vis = vis.withColumn("v", F.hypot("re", "im"))
        products = {n: (vis.where(c), ["ant1", "ant2", "pol"]) for n, c in (("auto", "ant1 = ant2"), ("cross", "ant1 <> ant2"))}
        apriori = None
        if a.a_priori:
            spec = flags.load_flag_spec(spark, a.a_priori)
            grid = vis.select("time_idx", "chan", "jd", "lst_hr", "freq_hz", F.lit(False).alias("flag")).distinct()
            apriori = flags.apply_a_priori(grid, spec, grid.select("chan", "freq_hz").distinct(), grid.select("time_idx", "jd", "lst_hr").distinct(), flag_ants=False)
        for k, df in runs.xrfi(products, apriori, (a.sig_init_med, a.sig_adj_med), (a.sig_init_mean, a.sig_adj_mean), a.Kt, a.Kf).items():
            put(df, k)
    elif a.run == "day_threshold":
        first, second = (tables.read_table(spark, p) for p in (a.first, a.second))
        put(runs.day_threshold(second, first, nsig=(a.nsig_f, a.nsig_t, a.nsig_f_adj, a.nsig_t_adj)), "flags")
    elif a.run == "night_xrfi":

        def of_nights(df):
            return nights.numbered(df.withColumn("night", F.floor("jd").cast("int")))

        bad = flags.ex_antennas(spark, a.ex_ants)
        vis = of_nights(flags.flag_antennas(tables.read_vis(spark, *paths(a.vis)), bad).where("NOT flag"))
        products, cal = night_plans.vis_products(vis), None
        if a.cal:
            cal = of_nights(tables.read_cal(spark, *paths(a.cal)))
            products |= night_plans.cal_products(cal, "cal")

        def kept(df, name: str):
            put(df, name)
            return tables.read_table(spark, f"{a.out.rstrip('/')}/{name}")

        how = ((a.sig_init_med, a.sig_adj_med), (a.sig_init_mean, a.sig_adj_mean), a.Kt, a.Kf, not a.keep_edges)
        out = night_plans.xrfi(products, None, *how, keep=kept)
        if cal is not None:
            put(night_plans.flag_solutions(cal, out["flags"], bad), "cal")
    elif a.run == "h1c_run":
        vis = flags.flag_antennas(tables.read_vis(spark, *paths(a.vis)), flags.ex_antennas(spark, a.ex_ants)).where("NOT flag").drop("flag")
        cal = tables.read_cal(spark, *paths(a.cal)).drop("flag") if a.cal else None
        out = night_plans.h1c_run(vis.withColumn("v", F.hypot("re", "im")), cal, a.px_threshold, a.freq_threshold, a.time_threshold, a.Kt, a.Kf, a.sig_init, a.sig_adj)
        for k, df in out.items():
            put(df, k)
    elif a.run == "auto_rfi":
        freqs = tables.read_vis(spark, *paths(a.autos), columns=["chan", "freq_hz"]).distinct().orderBy("chan").collect()  # a row a channel
        classes, shares = runs.auto_rfi_class(
            tables.read_autos(spark, *paths(a.autos)), [r["freq_hz"] for r in freqs], a.int_count, flags.ex_antennas(spark, a.ex_ants), nsig=a.nsig, share=a.flag_broadcast_thresh
        )
        put(classes, "classes")
        put(shares, "shares")
    elif a.run == "array_view":
        autos = tables.read_autos(spark, *paths(a.autos))
        ants = spark.read.parquet(a.ants)
        view = plots.array_view(autos, ants, not a.linear)
        put(view, "view")
        put(plots.weak_antennas(view), "weak")
        put(plots.rms_histogram(autos, ants), "histogram")
    else:
        vis = flags.flag_antennas(tables.read_vis(spark, *paths(a.vis)), flags.ex_antennas(spark, a.ex_ants))
        put(flags.apply_flags(vis, tables.read_table(spark, a.flags)).drop("net_flag"), "vis")


if __name__ == "__main__":
    main()

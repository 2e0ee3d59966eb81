"""Canonical schemas and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIS = (
    "obs string, time_idx int, jd double, lst_hr double, chan int, freq_hz double, ant1 int, ant2 int, pol string, "
    "re double, im double, flag boolean, nsample double, int_time double, chan_width double"
)
CAL = (
    "obs string, time_idx int, jd double, chan int, freq_hz double, ant int, antpol string, gain_re double, gain_im double, "
    "chisq double, delay_s double, flag boolean"
)
CAL_TOTAL = "obs string, time_idx int, jd double, chan int, freq_hz double, antpol string, total_chisq double"
QM_BASELINE = "time_idx int, chan int, ant1 int, ant2 int, pol string, metric double, weight double, flag boolean"
QM_ANTENNA = "time_idx int, chan int, ant int, antpol string, metric double, weight double, flag boolean"
QM_WATERFALL = (
    "product string, time_idx int, jd double, lst_hr double, chan int, freq_hz double, pol string, metric double, weight double, flag boolean"
)
CORR = "pol string, ant1 int, ant2 int, corr double"
ANT_CLASS = "ant int, antpol string, class string"
ANT_METRIC = "metric string, ant int, antpol string, iter int, value double"
ARRAY_METRIC = "metric string, pol string, value double"
EX_ANTS = "ant int, antpol string, reason string, removal_iteration int"

#: pol, its two feeds, whether they are equal, and the number of its product.
POLS = [("ee", "Jee", "Jee", True, -5), ("nn", "Jnn", "Jnn", True, -6), ("en", "Jee", "Jnn", False, -7), ("ne", "Jnn", "Jee", False, -8)]


def pol_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLS, "pol string, antpol1 string, antpol2 string, is_same_pol boolean, jones_num int")


#: Descriptions of the exported metrics.
METRICS = {
    "ant_metrics_corr": "mean correlation of an antenna with the others in its polarization",
    "ant_metrics_corrXPol": "largest mean excess of same- over cross-polarization correlations",
    "ant_metrics_removal_iter": "iteration of the search in which an antenna was removed, -1 before it",
    "auto_metrics_shape": "modified z-score of the shape of an antenna's bandpass",
    "auto_metrics_power": "modified z-score of the power of an antenna's autocorrelation",
    "auto_metrics_temp_var": "modified z-score of the variability in time",
    "auto_metrics_temp_diff": "modified z-score of the differences between integrations",
    "firstcal_metrics_ant_std": "scatter in time of an antenna's delay",
    "firstcal_metrics_agg_std": "scatter of all delays",
    "firstcal_metrics_max_std": "largest scatter of an antenna's delay",
    "omnical_metrics_chisq_ant_std": "scatter of an antenna's chi-square",
    "omnical_metrics_ant_phs_std": "scatter of an antenna's gain phase",
}


def metric_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(METRICS.items()), "metric string, description string")

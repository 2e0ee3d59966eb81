"""Antenna classes: bounds, checkers and the merge of classifications."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylens.functions.expr import INF, is_true, safe_divide
from arraylens.operators.iterate import blame
from arraylens.operators.windows import rank_filter_1d

ANT = ["ant", "antpol"]


def is_bound(x) -> bool:
    try:
        lo, hi = x
        return float(lo) <= float(hi)
    except (TypeError, ValueError):
        return False


def check_antpol(antpol: tuple) -> None:
    if not (isinstance(antpol, tuple) and len(antpol) == 2 and isinstance(antpol[0], int) and antpol[1] in ("Jee", "Jnn")):
        raise ValueError(f"{antpol!r} is no antenna and feed")


def bounds_class(value: Column, **bounds) -> Column:
    """The first class one of whose inclusive ranges holds the value; NULL if none does."""
    out = None
    for name, ranges in bounds.items():
        ranges = [ranges] if is_bound(ranges) else list(ranges)
        for r in ranges:
            if not is_bound(r):
                raise ValueError(f"{r!r} is no range")
            hit = is_true((value >= F.lit(float(r[0]))) & (value <= F.lit(float(r[1]))) & ~F.isnan(value))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    if out is None:
        raise ValueError("no class is given")
    return out


def classify(values: DataFrame, value: str = "value", **bounds) -> DataFrame:
    """(ant, antpol, class) of antennas whose value is in a range; the others stay unclassified."""
    return values.select(*ANT, bounds_class(F.col(value), **bounds).alias("class")).where("class is not null")


def with_bad(values: DataFrame, value: str = "value", good=(0, 0), suspect=(0, 0)) -> DataFrame:
    """Classes by a good and a suspect range; everything else, NaN and NULL too, is bad."""
    c = F.coalesce(bounds_class(F.col(value), good=good, suspect=suspect), F.lit("bad"))
    return values.select(*ANT, c.alias("class"))


class AntennaClassification:
    """A set of (ant, antpol, class) rows with the names of its good, suspect and bad class."""

    def __init__(self, table: DataFrame, good: str = "good", suspect: str = "suspect", bad: str = "bad"):
        self.table, self.good, self.suspect, self.bad = table.select(*ANT, "class"), good, suspect, bad

    def define_quality(self, good: str = "good", suspect: str = "suspect", bad: str = "bad") -> AntennaClassification:
        return AntennaClassification(self.table, good, suspect, bad)

    @property
    def quality_classes(self) -> list[str]:
        return [self.good, self.suspect, self.bad]

    @property
    def classes(self) -> list[str]:
        return sorted(r["class"] for r in self.table.select("class").distinct().collect())

    def get_all(self, name: str) -> DataFrame:
        return self.table.where(F.col("class") == name).select(*ANT)

    def ants(self) -> DataFrame:
        return self.table.select(*ANT)

    def good_ants(self) -> DataFrame:
        return self.get_all(self.good)

    def suspect_ants(self) -> DataFrame:
        return self.get_all(self.suspect)

    def bad_ants(self) -> DataFrame:
        return self.get_all(self.bad)

    def __getitem__(self, antpol: tuple[int, str]) -> str:
        check_antpol(antpol)
        row = self.table.where((F.col("ant") == antpol[0]) & (F.col("antpol") == antpol[1])).first()
        if row is None:
            raise KeyError(antpol)
        return row["class"]

    def with_class(self, antpol: tuple[int, str], name: str) -> AntennaClassification:
        """A copy in which one antenna has another class."""
        check_antpol(antpol)
        rest = self.table.where(~((F.col("ant") == antpol[0]) & (F.col("antpol") == antpol[1])))
        one = self.table.sparkSession.createDataFrame([(*antpol, name)], "ant int, antpol string, class string")
        return AntennaClassification(rest.unionByName(one), *self.quality_classes)

    def is_good(self, antpol: tuple[int, str]) -> bool:
        return self[antpol] == self.good

    def is_suspect(self, antpol: tuple[int, str]) -> bool:
        return self[antpol] == self.suspect

    def is_bad(self, antpol: tuple[int, str]) -> bool:
        return self[antpol] == self.bad

    def to_quality(self, good: Sequence[str] = (), suspect: Sequence[str] = (), bad: Sequence[str] = ()) -> AntennaClassification:
        """Classes renamed to quality classes; a class that is in none of the lists raises ValueError."""
        known = {**{c: "good" for c in good}, **{c: "suspect" for c in suspect}, **{c: "bad" for c in bad}}
        known |= {c: c for c in ("good", "suspect", "bad") if c not in known}
        left = [c for c in self.classes if c not in known]
        if left:
            raise ValueError(f"no quality is given for {left}")
        out = F.lit(None).cast("string")
        for c, q in known.items():
            out = F.when(F.col("class") == c, q).otherwise(out)
        return AntennaClassification(self.table.select(*ANT, out.alias("class")))

    def __add__(self, other: AntennaClassification) -> AntennaClassification:
        """Bad where either is bad, good where both are good, else suspect; antennas of one side keep their class."""
        if not isinstance(other, AntennaClassification):
            raise TypeError("only classifications can be added")
        if self.quality_classes != other.quality_classes:
            raise ValueError("the quality classes differ")
        both = self.table.join(other.table.withColumnRenamed("class", "_o"), ANT, "full_outer")
        a, b = F.col("class"), F.col("_o")
        c = F.when(a.isNull(), b).when(b.isNull(), a).when((a == self.bad) | (b == self.bad), self.bad)
        c = c.when((a == self.good) & (b == self.good), self.good).otherwise(self.suspect)
        return AntennaClassification(both.select(*ANT, c.alias("class")), *self.quality_classes)


# Checkers on autos (ant, antpol, time_idx, chan, v)


def auto_power(autos: DataFrame, counts: float = 1.0) -> DataFrame:
    """(ant, antpol, value): median power over the samples that an integration averages."""
    return autos.groupBy(*ANT).agg((F.median(F.abs("v")) / F.lit(float(counts))).alias("value"))


def auto_slope(autos: DataFrame, edge_cut: int = 100, size: int = 17) -> DataFrame:
    """(ant, antpol, value): slope over offset of a line through the median-filtered mean spectrum between the edges.

    The axis runs from -0.5 to 0.5 over the whole band, edges too. An all-zero spectrum
    has slope 0, a zero offset an infinite one.
    """
    mean = autos.groupBy(*ANT, "chan").agg(F.avg("v").alias("m"))
    smooth = rank_filter_1d(mean, "chan", ANT, size // 2, "m", "s")
    n = smooth.agg((F.max("chan") + 1).alias("_n"))  # one row
    x = smooth.crossJoin(F.broadcast(n)).where((F.col("chan") >= edge_cut) & (F.col("chan") < F.col("_n") - edge_cut))
    axis = F.col("chan") / (F.col("_n") - 1) - 0.5
    fit = x.withColumn("_x", axis).groupBy(*ANT).agg(
        F.regr_slope("s", "_x").alias("_a"), F.regr_intercept("s", "_x").alias("_b"), F.max(F.abs("s")).alias("_top")
    )
    value = F.when(F.col("_top") == 0, 0.0).when(F.col("_b") == 0, F.signum("_a") * F.lit(INF)).otherwise(safe_divide("_a", "_b"))
    return fit.select(*ANT, value.alias("value"))


def auto_shape(autos: DataFrame, good: DataFrame | None = None) -> DataFrame:
    """(ant, antpol, value): RMS distance of the unit-mean bandpass from the mean of good antennas; infinite without any."""
    s = autos.groupBy(*ANT, "chan").agg(F.avg("v").alias("m"))
    s = s.join(s.groupBy(*ANT).agg(F.avg("m").alias("_mean")), ANT).select(*ANT, "chan", safe_divide("m", "_mean").alias("s"))
    ref = (s if good is None else s.join(good.select(*ANT), ANT, "left_semi")).groupBy("antpol", "chan").agg(F.avg("s").alias("r"))
    d = s.join(ref, ["antpol", "chan"], "left").groupBy(*ANT).agg(F.sqrt(F.avg(F.pow(F.col("s") - F.col("r"), F.lit(2)))).alias("v"))
    return d.select(*ANT, F.coalesce("v", F.lit(INF)).alias("value"))


def auto_rfi(flags: DataFrame, array: DataFrame) -> DataFrame:
    """(ant, antpol, value): share of an antenna's pixels flagged in excess of the array's flags."""
    both = flags.join(array.select("time_idx", "chan", F.col("flag").alias("_a")), ["time_idx", "chan"], "left")
    a = is_true(F.col("_a"))
    share = F.avg((F.col("flag") | a).cast("double")) - F.avg(a.cast("double"))
    return both.groupBy(*ANT).agg(share.alias("value"))


def even_odd_zeros(total: DataFrame, diff: DataFrame) -> DataFrame:
    """(ant1, ant2, pol, n): most zeros of one spectrum in the even or odd samples of a baseline."""
    keys = ["ant1", "ant2", "pol", "time_idx", "chan"]
    both = total.join(diff.select(*keys, F.col("re").alias("dr"), F.col("im").alias("di")), keys)
    even = (F.col("re") + F.col("dr") == 0) & (F.col("im") + F.col("di") == 0)
    odd = (F.col("re") - F.col("dr") == 0) & (F.col("im") - F.col("di") == 0)
    per = both.groupBy("ant1", "ant2", "pol", "time_idx").agg(F.count_if(even).alias("e"), F.count_if(odd).alias("o"))
    return per.groupBy("ant1", "ant2", "pol").agg(F.max(F.greatest("e", "o")).alias("n"))


def feeds(baselines: DataFrame) -> DataFrame:
    """baselines with antpol1 and antpol2 of their pol."""
    p = F.col("pol")
    first = F.when(F.substring(p, 1, 1) == "e", "Jee").otherwise("Jnn")
    second = F.when(F.substring(p, 2, 1) == "e", "Jee").otherwise("Jnn")
    return baselines.withColumns({"antpol1": first, "antpol2": second})


def even_odd_zeros_class(total: DataFrame, diff: DataFrame, good=(0, 2), suspect=(2, 8)) -> DataFrame:
    return with_bad(blame(feeds(even_odd_zeros(total, diff))), "n", good, suspect)


def xengine_counts(diff: DataFrame, chans: int = 96, cut: float = 10.0) -> DataFrame:
    """(ant1, ant2, pol, n): times and blocks of channels of a baseline whose differences are not like noise.

    diff has re, im and sigma, the expected noise of a sample's difference, and
    may have `flag`. A sample's |d| is scored by the mean and spread of noise
    (Rayleigh; half-normal for autos); the mean size of a block's scores at one
    time is held against that of a half-normal one.
    """
    auto = (F.col("ant1") == F.col("ant2")) & (F.substring("pol", 1, 1) == F.substring("pol", 2, 1))
    mean = F.when(auto, (2 / pi) ** 0.5).otherwise((pi / 4) ** 0.5)
    spread = F.when(auto, (1 - 2 / pi) ** 0.5).otherwise((1 - pi / 4) ** 0.5)
    z = F.abs(safe_divide(F.hypot("re", "im") - mean * F.col("sigma"), spread * F.col("sigma")))
    if "flag" in diff.columns:
        z = F.when(~F.col("flag"), z)
    per = diff.groupBy("ant1", "ant2", "pol", "time_idx", F.expr(f"chan div {int(chans)}").alias("block")).agg(F.avg(z).alias("m"), F.count(z).alias("k"))
    score = (F.col("m") - (2 / pi) ** 0.5) / F.sqrt(F.lit(1 - 2 / pi) / F.col("k"))
    return per.groupBy("ant1", "ant2", "pol").agg(F.count_if(score > cut).alias("n"))


def xengine_class(diff: DataFrame, chans: int = 96, cut: float = 10.0) -> DataFrame:
    """Antennas by the bad blocks they are blamed for: good without any, else bad."""
    return classify(blame(feeds(xengine_counts(diff, chans, cut))), "n", good=(0, 0), bad=(1, INF))

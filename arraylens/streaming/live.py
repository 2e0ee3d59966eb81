"""Live autocorrelations with Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arraylens.operators import kernels
from arraylens.operators.nights import REACH


def live_power(autos: DataFrame, time: str = "ts", length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, ant, pol, power, n): mean power of each antenna in tumbling windows of a stream (ts, ant, pol, v).

    Samples that come later than `late` after the newest one are dropped.
    """
    x = autos.withWatermark(time, late).groupBy(F.window(time, length), "ant", "pol")
    return x.agg(F.avg("v").alias("power"), F.count("v").alias("n")).select(F.col("window.start").alias("start"), "ant", "pol", "power", "n")


def live_flags(autos: DataFrame, low: float, high: float) -> DataFrame:
    """The stream with `flag` where a sample's power is out of range; keeps no state."""
    return autos.withColumn("flag", ~F.coalesce(F.col("v").between(low, high), F.lit(False)))


def live_filter(
    autos: DataFrame, algorithm: str = "detrend_medfilt", kt: int = 2, kf: int = 2, first: float = 6.0, time: str = "ts", late: str = "1 minute", keys: Sequence[str] = ("ant", "pol")
) -> DataFrame:
    """(keys, time_idx, chan, v, z, flag) of a stream (ts, keys, time_idx, chan, v): the filter of each waterfall as it grows.

    An integration is given out once all that the filter reaches behind it are
    final, that is older than the watermark; its values are those of the whole
    waterfall. The state of a waterfall holds the integrations that the next ones
    reach back to, and those that wait: twice the filter's reach and what `late`
    allows, however long the stream. Rows later than that are dropped. The last
    integrations wait for more. Times rise with time_idx.
    """
    reach = REACH[algorithm](kt)
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in autos.schema}
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "time_idx int, chan int, v double, z double, flag boolean"])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = pickle.loads(state.get[0]) if state.exists else (None, None)
        held = pd.concat([x for x in (held, *parts) if x is not None and len(x)] or [pd.DataFrame(columns=["at", "time_idx", "chan", "v"])])
        mark = state.getCurrentWatermarkMs()
        final = held.loc[held["at"] < mark, "time_idx"]
        if len(final):
            start = int(held["time_idx"].min()) if done is None else done + 1
            stop = int(final.max()) - reach  # the last that is given out
            if stop >= start:
                low = max(int(held["time_idx"].min()), start - reach)
                frame = held[(held["time_idx"] >= low) & (held["time_idx"] <= int(final.max()))]
                t, f = frame["time_idx"].to_numpy(int) - low, frame["chan"].to_numpy(int)
                x = np.full((t.max() + 1, f.max() + 1), np.nan)
                x[t, f] = frame["v"].to_numpy(float)
                z = kernels.ALGORITHMS[algorithm](x, None, kt, kf)[t, f]
                given = pd.DataFrame({**dict(zip(keys, key, strict=True)), "time_idx": (t + low).astype("int32"), "chan": f.astype("int32"), "v": frame["v"].to_numpy(float), "z": z})
                given["flag"] = given["z"] >= first
                yield given[(given["time_idx"] >= start) & (given["time_idx"] <= stop)]
                held, done = held[held["time_idx"] > stop - reach], stop
        state.update((pickle.dumps((held, done)),))
        waiting = held.loc[held["at"] >= mark, "at"]
        if len(waiting):
            state.setTimeoutTimestamp(int(waiting.min()) + 1)

    rows = autos.withWatermark(time, late).withColumn("at", F.unix_millis(time)).groupBy(*keys)
    return rows.applyInPandasWithState(lambda k, p, s: run(k, (x[["at", "time_idx", "chan", "v"]] for x in p), s), out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)

"""A growing waterfall filtered as a stream gives what the whole one gives."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from arraylens.operators import kernels
from arraylens.streaming.live import live_filter

START = datetime(2024, 1, 1)


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = {a: 50 + rng.normal(size=(26, 8)) for a in (1, 2)}
    x[2][9, 4] += 300
    rows = [(START + timedelta(seconds=10 * t), a, "ee", t, c, float(v[t, c])) for a, v in x.items() for t in range(26) for c in range(8)]
    late = [r for r in rows if r[3] in (5, 12) and r[4] == 3]  # come two files on, within the minute
    files = [[r for r in rows if r not in late and r[3] // 4 == i] for i in range(7)]
    files[2] += [r for r in late if r[3] == 5]
    files[4] += [r for r in late if r[3] == 12]
    schema = "ts timestamp, ant int, pol string, time_idx int, chan int, v double"
    (tmp_path / "in").mkdir()
    for i, part in enumerate(files):
        spark.createDataFrame(pd.DataFrame(part, columns=["ts", "ant", "pol", "time_idx", "chan", "v"]), schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        file.rename(tmp_path / "in" / f"{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live_filter(stream, kt=2, kf=2, first=20.0, late="60 seconds").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("live").collect()
    given = {(r.ant, r.time_idx, r.chan): r for r in got}
    last = max(r.time_idx for r in got)
    assert len(given) == len(got) and last >= 12
    assert given.keys() == {(a, t, c) for a in x for t in range(last + 1) for c in range(8)}
    want = {a: kernels.detrend_medfilt(v, None, 2, 2) for a, v in x.items()}
    assert all(np.isclose(r.z, want[a][t, c]) and r.flag == (want[a][t, c] >= 20.0) for (a, t, c), r in given.items())
    assert given[2, 9, 4].flag

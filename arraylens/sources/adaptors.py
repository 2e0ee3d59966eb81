"""Waterfall-like views of the generic tables `events` and `embeddings`.

Each adaptor is one SQL text; DAY and the array functions differ by engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids that are numbered in one group.
BLOCK = 4096

_DAY = {"spark": "timestampdiff(DAY, timestamp_ntz'2024-01-01', ts)", "duckdb": "datediff('day', TIMESTAMP '2024-01-01', ts)"}

_AUTOS = """
SELECT CAST(user_id % 10 AS INT) AS ant, CASE WHEN event_id % 2 = 0 THEN 'ee' ELSE 'nn' END AS pol,
       CAST({day} AS INT) AS time_idx, CAST(hour(ts) AS INT) AS chan, round(avg(value), 6) AS v
FROM {events} GROUP BY 1, 2, 3, 4
"""
_WATERFALL = """
SELECT CAST({day} AS INT) AS time_idx, CAST(hour(ts) AS INT) AS chan, round(avg(value), 6) AS v
FROM {events} GROUP BY 1, 2
"""
#: Integrations of a label's spectra that are used; they run from 0 by vec_id.
_SPECTRA = {
    "spark": """
SELECT label AS ant, time_idx, CAST(p AS INT) AS chan, CAST(x AS DOUBLE) AS re, CAST(embedding[63 - p] AS DOUBLE) AS im
FROM {numbered}
LATERAL VIEW posexplode(embedding) AS p, x
""",
    "duckdb": """
SELECT label AS ant, time_idx, CAST(p - 1 AS INT) AS chan, CAST(embedding[p] AS DOUBLE) AS re, CAST(embedding[65 - p] AS DOUBLE) AS im
FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS time_idx, embedding FROM embeddings),
     (SELECT unnest(range(1, 65)) AS p)
""",
}

_FEEDS = "(SELECT ant, 'e' AS f, time_idx, chan, re, im FROM {spec} UNION ALL SELECT ant, 'n' AS f, time_idx, chan, im AS re, re AS im FROM {spec})"
#: Visibilities of all pairs of labels, autocorrelations included; the second feed has the spectra with their parts exchanged.
_VIS = f"""
SELECT a.ant AS ant1, b.ant AS ant2, concat(a.f, b.f) AS pol, a.time_idx, a.chan, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im
FROM {_FEEDS} a JOIN {_FEEDS} b ON a.time_idx = b.time_idx AND a.chan = b.chan AND a.ant <= b.ant
"""

#: Common table expressions for DuckDB; ad_vis stands on ad_spec.
DUCKDB = {
    "ad_autos": _AUTOS.format(day=_DAY["duckdb"], events="events"),
    "ad_wf": _WATERFALL.format(day=_DAY["duckdb"], events="events"),
    "ad_spec": _SPECTRA["duckdb"],
    "ad_vis": _VIS.format(spec="ad_spec"),
}


def _events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.format(day=_DAY["spark"], events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def autos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ant, pol, time_idx, chan, v): autocorrelation-like waterfalls with gaps."""
    return _events(spark, sf_dir, _AUTOS)


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time_idx, chan, v): one waterfall."""
    return _events(spark, sf_dir, _WATERFALL)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, time_idx, embedding): the rows of each label, numbered from 0 by vec_id.

    Ranges of BLOCK ids are counted first and numbered by themselves, so no
    task has all rows of a label. Rows without label or id are numbered too.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("_k", F.struct("label", F.expr(f"vec_id div {BLOCK}").alias("block")))  # one key: its nulls are equal
    earlier = Window.partitionBy("_k.label").orderBy("_k.block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("_k").agg(F.count("*").alias("_n")).select("_k", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    at = F.row_number().over(Window.partitionBy("_k").orderBy("vec_id")) - 1 + F.col("_first")
    return rows.join(first, "_k").select("label", at.cast("int").alias("time_idx"), "embedding")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ant, time_idx, chan, re, im): complex spectra."""
    return spark.sql(_SPECTRA["spark"], numbered=numbered(spark, sf_dir))


def integrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ant, time_idx, re, im): the spectra, one row with arrays over the channels for each."""
    x = F.col("embedding").cast("array<double>")
    return numbered(spark, sf_dir).select(F.col("label").alias("ant"), "time_idx", x.alias("re"), F.reverse(x).alias("im"))


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ant1, ant2, pol, time_idx, chan, re, im): products of all pairs of spectra and feeds."""
    return spark.sql(_VIS, spec=spectra(spark, sf_dir))

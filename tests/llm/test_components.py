"""Components of edge tables, hubs among them, and tables kept in the shared folder."""

import random

import pytest
from pyspark.sql import functions as F

from arraylens.llm.components import SALTS, connected_components, to_least
from arraylens.llm.staging import Stage, fresh


def plain(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edges_and_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5, 5), (None, 3), (7, None)] + edges[:20]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), Stage(spark)).collect()}
    assert got == plain(edges)


def test_a_hub_of_many_edges(spark):
    n = 100_000
    edges = spark.range(1, n + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    out = connected_components(edges, Stage(spark))
    assert out.agg(F.count("*"), F.count_distinct("node"), F.max("component")).first()[:] == (n + 1, n + 1, 0)


def test_edges_meet_their_minimum_whatever_their_salt(spark):
    edges = spark.createDataFrame([(1, v) for v in range(2, 60)] + [(2, 9)], "u long, v long")
    least = spark.createDataFrame([(1, 1), (2, 2), (4, 0)], "u long, m long")
    got = to_least(edges, least)
    assert sorted(map(tuple, got.select("u", "v", "m").collect())) == sorted([(1, v, 1) for v in range(2, 60)] + [(2, 9, 2)]) and SALTS > 1


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Stage(spark)).collect() == []


def test_kept_tables_are_read_back_and_dropped(spark):
    stage = Stage(spark)
    kept = stage.keep(spark.range(5), "five")
    assert kept.count() == 5 and "five" in kept._stage_path
    stage.drop(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept._stage_path).count()
    assert fresh(["A", "b_"], "a", "b", "a") == ["a_", "b", "a__"]

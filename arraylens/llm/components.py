"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylens.llm.staging import Stage

#: Parts over which the edges of a node are dealt where they meet its minimum.
SALTS = 8


def to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m, the minimum of u in least (u, m); the edges of one node are dealt over SALTS tasks."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", salt).join(salted, ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, stage: Stage, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node id that each linked node reaches.

    Large-star and small-star steps alternate until the edges are stars around
    their smallest node. Minima are partially aggregated before they are
    shuffled. A node's edges meet its minimum in SALTS tasks, each minimum being
    sent to all of them, and the tables that are joined are written ones, so that
    larger hubs can be split further as the join runs. Nodes without edges do not
    appear; self loops and null ends are ignored.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = stage.keep(e.distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage.keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = to_least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.keep(large.where("u <> v").distinct(), "large")
        least = stage.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = to_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stage.keep(small, "stars")
        stage.drop(e, low, large, least)
        e = new
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

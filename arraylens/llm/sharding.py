"""Sharding by a hierarchical weighted hash tree (operator 9), DataFrame functions only.

Every row descends region, rack and shard. At a node with children of weight
w_c, the row draws u_c in (0, 1) from the hash of its key and the child's path
and goes to the child with the smallest -ln(u_c) / w_c, which is child c with
probability w_c / sum(w). A draw depends on nothing but the key and the path:
when a weight changes, the draws of all other children stay, so rows move only
into or out of the subtree whose weight has changed. A place in the tree may be
closed: rows that reach it go on to the open shard that wins a flat draw, so
opening it moves rows into it and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arraylens.llm.staging import Stage, with_text

#: Parts in which the rows of one shard are numbered side by side.
CHUNKS = 4096


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0
    closed: bool = False  # keeps its place and weight in the tree but holds nothing


def tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, base: int = 8) -> list[Shard]:
    """`shards` equal shards: `base` places in regions and racks, closed beyond `shards`; each later one is a region of its own.

    One more shard opens a closed place, whose weight stood before, or adds a
    region: either way it takes rows only into itself.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    out = []
    for i in range(base):
        rack = i // shards_per_rack
        out.append(Shard(f"region{rack // racks_per_region}", f"rack{rack}", i, closed=i >= shards))
    return out + [Shard(f"added{i}", f"added{i}", i) for i in range(base, shards)]


def draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the hash of key and path."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def descend(key: Column, shards: list[Shard]) -> Column:
    """Number of the shard that a key reaches; from a closed one it goes on to the open one with the best draw of all."""

    def pick(children: list[tuple[str, float, Column]]) -> Column:
        if len(children) == 1:
            return children[0][2]
        drawn = [F.struct(draw(key, path, w).alias("d"), F.lit(i).alias("i")) for i, (path, w, _) in enumerate(children)]
        best = F.least(*drawn)["i"]
        out = F.when(best == 0, children[0][2])
        for i, (_, _, below) in enumerate(children[1:], 1):
            out = out.when(best == i, below)
        return out

    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.weight > 0:
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    if not regions:
        raise ValueError("no shard has a weight above 0")
    lost = [s.number for s in shards if s.weight > 0 and s.closed]
    still = [(f"again/{s.region}/{s.rack}/{s.number}", s.weight, F.lit(s.number)) for s in shards if s.weight > 0 and not s.closed]
    if not still:
        raise ValueError("no shard is open")
    top = []
    for region, racks in regions.items():
        middle = []
        for rack, leaves in racks.items():
            low = [(f"{region}/{rack}/{s.number}", s.weight, F.lit(s.number)) for s in leaves]
            middle.append((f"{region}/{rack}", sum(s.weight for s in leaves), pick(low)))
        top.append((region, sum(s.weight for x in racks.values() for s in x), pick(middle)))
    found = pick(top)
    return F.when(found.isin(*lost), pick(still)).otherwise(found) if lost else found


def assign(df: DataFrame, key: str, shards: list[Shard], out: str = "shard") -> DataFrame:
    """df with the shard of each row; rows with equal keys, nulls too, share one."""
    return df.withColumn(out, descend(F.col(f"`{key}`"), shards).cast("int"))


def number(df: DataFrame, by: list[str], shard: str = "shard", out: str = "slot") -> DataFrame:
    """df with gapless numbers from 0 in each shard, without sorting a shard in one task.

    The rows of a shard are dealt over CHUNKS parts by the hash of the ordering
    columns and the partition they lie in; parts are numbered on their own and
    shifted by the sizes of the parts before. The table of sizes has CHUNKS rows
    a shard, whatever the input, and is broadcast. df must give the same rows in
    the same partitions each time it is read (a written table does).
    """
    parts = df.withColumn("_chunk", F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.lit(CHUNKS)).cast("int"))
    parts = parts.select("*", F.spark_partition_id().alias("_part"))
    sizes = parts.groupBy(shard, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(shard, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(shard, "_chunk").orderBy(*by, "_part")
    parts = parts.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(sizes), [shard, "_chunk"])
    return parts.withColumn(out, F.col("_from") + F.col("_at")).drop("_chunk", "_part", "_from", "_at")


def shard_documents(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, under the law `key`.

    size is the text's UTF-8 bytes plus 1 (1 for null and empty texts, whose
    CRC is 0). doc_id and the number of shards alone decide the shard;
    grown_shard is that among one more shard, which equals shard or is the new
    one. Null ids go to one shard as one key does. Repeated rows each get a slot;
    an empty table gives an empty one; other columns are ignored.
    """
    stage = Stage(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = with_text(documents, id_col, text_col).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(rows, "doc_id", tree(shards))
    rows = assign(rows, "doc_id", tree(shards + 1), "grown_shard")
    rows = number(stage.keep(rows, "rows"), ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

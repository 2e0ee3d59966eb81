"""Embedding near-dedup (operator 6): PCA-ordered tiled comparison.

Unit vectors are turned into the axes of their principal components, found from
the second moments of all of them. Equal vectors become one with a weight. Each
label's vectors are put in the order of the interleaved bits of their leading
components and cut into tiles, so that a tile is small in several components at
once. A tile's box holds the ranges of its leading components and of the norm of
the rest. Tiles meet in the cells of a grid over the first two components, as
wide as the threshold's chord, and go on as a pair only if their boxes are no
further apart than the chord. In such a pair the leading components are
multiplied first, and a pair of vectors is given up when its product so far and
the bound on the rest, the product of the two suffix norms, cannot reach the
threshold. Products within BORDER of the threshold are decided again on the
vectors as given. A tile pair sends for each linked vector one row, the count of
its links and one spanning edge, however many pairs link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraylens.llm.components import connected_components
from arraylens.llm.staging import Stage, bound_batches

#: Vectors of a tile. A tile pair takes TILE * TILE doubles of memory.
TILE = 1024
#: Leading components that order the vectors, bits of each, and components of a tile's box.
ORDERED, BITS, BOX = 6, 3, 12
#: Distance from the threshold within which a product is decided again on the vectors as given.
BORDER = 1e-9
#: Shares of the components after which products are held against the bound.
STEPS = (0.125, 0.25, 0.5, 1.0)
#: Groups in which the partial covariances of tasks are added up before the last sum.
PARTIALS = 64


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null, zero and non-finite ones are left out."""
    for batch in batches:
        ids, labels, unit, dims = [], [], [], []
        for i, lab, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if i is None or lab is None or not v or None in v:
                continue
            x = np.array(v, np.float64)
            big = np.abs(x).max()
            if not np.isfinite(big) or big == 0:
                continue
            x = x / big
            ids.append(i), labels.append(lab), dims.append(len(x)), unit.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())],
            names=["vec_id", "label", "dim", "unit"],
        )


def _covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims):
            rows = batch.column(1).filter(pa.array(dims == d)).to_pylist()
            x = np.frombuffer(b"".join(rows)).reshape(len(rows), int(d))
            held[int(d)] = held.get(int(d), 0) + x.T @ x
    part = TaskContext.get().partitionId() % PARTIALS
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([c.tobytes() for c in held.values()], pa.binary())],
        names=["dim", "part", "sums"],
    )


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"dim": table.column("dim")[:1], "part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def order_of(x: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Interleaved bits of the rows' leading columns, each cut into 2 ** BITS parts of four spreads about 0."""
    k = min(ORDERED, x.shape[1])
    t = (x[:, :k] / np.maximum(spread[:k], 1e-12) + 2) / 4
    q = np.clip(t * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    code = np.zeros(len(x), np.int64)
    for bit in reversed(range(BITS)):
        for c in range(k):
            code = code << 1 | q[:, c] >> bit & 1
    return code


def box_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values of BOX leading columns and of the norm of the others, over the rows."""
    y = np.zeros((len(x), BOX + 1))
    k = min(BOX, x.shape[1])
    y[:, :k] = x[:, :k]
    y[:, BOX] = np.sqrt(np.maximum((x[:, k:] ** 2).sum(1), 0))
    return y.min(0), y.max(0)


def compare(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a and b with a product of `least` or more, and the products; leading columns first."""
    d = a.shape[1]
    stops = sorted({max(1, round(d * s)) for s in STEPS})
    i = j = s = None
    done = 0
    total = np.zeros((len(a), len(b)))
    for stop in stops:
        rest_a, rest_b = (np.sqrt(np.maximum((x[:, stop:] ** 2).sum(1), 0)) for x in (a, b))
        slack = 0 if stop == d else 1e-9
        if i is None:
            total += a[:, done:stop] @ b[:, done:stop].T
            open_ = total + np.outer(rest_a, rest_b) >= least - slack
            if stop == d or open_.sum() < 0.05 * open_.size:
                i, j = np.nonzero(open_)
                s = total[i, j]
        else:  # few pairs are left: they go on one by one
            keep = []
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                s[at : at + (1 << 16)] += np.einsum("nd,nd->n", a[x, done:stop], b[y, done:stop])
                keep.append(s[at : at + (1 << 16)] + rest_a[x] * rest_b[y] >= least - slack)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            i, j, s = i[keep], j[keep], s[keep]
        done = stop
    return i, j, s


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges i, j."""
    low = np.arange(n)
    while True:
        new = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tiles(size: int):
    names = ["tile", "label", "dim", "lo", "hi", "ids", "weights", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        key, held = None, []

        def tile() -> pa.RecordBatch:
            nonlocal n
            x = np.array([np.frombuffer(r[2]) for r in held])
            lo, hi = box_of(x)
            values = [part << 32 | n, key[0], key[1], lo.tolist(), hi.tolist(), [r[0] for r in held], [r[1] for r in held], x.tobytes()]
            n += 1
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for lab, dim, rep, weight, row in zip(*[batch.column(c).to_pylist() for c in ("label", "dim", "rep", "weight", "row")], strict=True):
                if held and ((lab, dim) != key or len(held) == size):
                    yield tile()
                    held = []
                key = lab, dim
                held.append((rep, weight, row))
        if held:
            yield tile()

    return run, "tile long, label string, dim int, lo array<double>, hi array<double>, ids array<long>, weights array<long>, rows binary"


def _links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.array(r["ids_a"]), np.array(r["ids_b"])
                weights = np.array(r["weights_a"]), np.array(r["weights_b"])
                a, b = (np.frombuffer(r[k]).reshape(len(ids[n]), -1) for n, k in enumerate(("rows_a", "rows_b")))
                i, j, s = compare(a, b, least - BORDER)
                if r["a"] == r["b"]:
                    i, j, s = i[i < j], j[i < j], s[i < j]
                near = s < least + BORDER
                if near.any():
                    x, y, wx, wy = ids[0][i[near]], ids[1][j[near]], weights[0][i[near]], weights[1][j[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (x, wy, y, wx)], names=["node", "links", "root", "other"])
                i, j = i[~near], j[~near]
                if r["a"] == r["b"]:
                    nodes = ids[0]
                    count = np.bincount(i, weights[0][j], len(nodes)) + np.bincount(j, weights[0][i], len(nodes))
                    low = roots(len(nodes), i, j)
                else:
                    nodes = np.concatenate(ids)
                    count = np.append(np.bincount(i, weights[1][j], len(a)), np.bincount(j, weights[0][i], len(b)))
                    low = roots(len(nodes), i, j + len(a))
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[at]), pa.array(count[at].astype(np.int64)), pa.array(nodes[low[at]]), pa.nulls(len(at), pa.int64())],
                    names=["node", "links", "root", "other"],
                )

    return run, "node long, links long, root long, other long"


def _decide(least: float):
    """Whether the vectors as given have a cosine of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)
            ok = [float(np.frombuffer(u) @ np.frombuffer(v)) >= least for u, v in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "links", "root", "other")], names=["node", "links", "root", "other"]).filter(
                pa.array(ok, pa.bool_())
            )

    return run, "node long, links long, root long, other long"


def _apart(n: int) -> Column:
    """Squared distance of the boxes of tiles a and b."""
    gaps = [F.greatest(F.col("a.lo")[i] - F.col("b.hi")[i], F.col("b.lo")[i] - F.col("a.hi")[i], F.lit(0.0)) for i in range(n)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _cells(marks: DataFrame, chord: float, around: int) -> DataFrame:
    """A row for each cell of the first two components that a tile's box touches, or cells `around` it."""
    for i, name in enumerate(("c0", "c1")):
        low, high = (F.floor(F.col(x)[i] / chord).cast("int") for x in ("lo", "hi"))
        marks = marks.withColumn(name, F.explode(F.sequence(low - around, high + around)))
    return marks


def tile_pairs(tiles: DataFrame, least: float) -> DataFrame:
    """(a, b), a <= b: tiles of one label and length whose boxes are no further apart than vectors with a cosine of `least`."""
    chord = float(np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9)
    marks = tiles.select("tile", "label", "dim", "lo", "hi")
    a, b = _cells(marks, max(chord, 1e-3), 0).alias("a"), _cells(marks, max(chord, 1e-3), 1).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dim", "c0", "c1")]
    meet = same[0] & same[1] & same[2] & same[3] & (F.col("a.tile") <= F.col("b.tile"))
    near = _apart(BOX + 1) <= chord * chord + 1e-9
    return a.join(b, meet).where(near).select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b")).distinct()


def embedding_duplicates(
    embeddings: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Rows link when their labels are equal and the cosine of their vectors, in
    double precision, is `least` or more; sums that differ in the last digits by
    order of addition may decide a pair at the threshold. n_links counts the other rows linked
    directly, copies each for itself; component_id is the smallest vec_id
    reachable by links; kept marks rows whose vec_id it is. Vectors that are null,
    empty, zero, or hold nulls or non-finite numbers, rows with a null label or
    id, and vectors of different lengths link with nothing. Repeated rows of one
    vec_id are vectors of their own that share a component; an empty table gives
    an empty one. Other columns, whatever their names, are ignored.
    """
    spark = embeddings.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    given = embeddings.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    units = stage.keep(given.mapInArrow(_valid, "vec_id long, label string, dim int, unit binary"), "units")
    ddl = "dim int, part int, sums binary"
    sums = units.select("dim", "unit").mapInArrow(_covariance, ddl).groupBy("dim", "part").applyInArrow(_add, ddl)
    sums = sums.groupBy("dim").applyInArrow(_add, ddl).collect()  # dim * dim numbers for each length of vectors
    bases = {}
    for r in sums:
        values, axes = np.linalg.eigh(np.frombuffer(r["sums"]).reshape(r["dim"], r["dim"]))
        order = np.argsort(-values)
        spread = np.sqrt(np.maximum(values[order], 0) / max(values.sum(), 1e-300))  # unit vectors: the sum is their number
        bases[r["dim"]] = np.ascontiguousarray(axes[:, order]), spread
    shared = spark.sparkContext.broadcast(bases)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, given = batch.column("dim").to_numpy(), batch.column("unit").to_pylist()
            out, codes = [b""] * len(given), np.zeros(len(given), np.int64)
            for dim in np.unique(dims):
                axes, spread = shared.value[int(dim)]
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(given[i] for i in at)).reshape(len(at), int(dim)) @ axes
                codes[at] = order_of(x, spread)
                for i, row in zip(at, x, strict=True):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "dim", "rep", "weight")), pa.array(out, pa.binary()), pa.array(codes, pa.int64())],
                names=["label", "dim", "rep", "weight", "row", "code"],
            )

    same = units.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    same = stage.keep(same, "classes")
    turned = stage.keep(same.mapInArrow(turn, "label string, dim int, rep long, weight long, row binary, code long"), "turned")
    # every partition is read whole by one task, which cuts it into tiles
    parts = max(1, -(-turned.count() // (4 * TILE)))
    # rep parts vectors of one code, which would else be one task
    dealt = turned.repartitionByRange(parts, "label", "dim", "code", "rep").sortWithinPartitions("label", "dim", "code", "rep")
    run, ddl = _tiles(TILE)
    tiles = stage.keep(dealt.mapInArrow(run, ddl), "tiles")
    pairs = tile_pairs(tiles, least)
    for side in "ab":
        body = tiles.select(F.col("tile").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "weights", "rows")])
        pairs = pairs.join(body, side)
    run, ddl = _links(least)
    found = stage.keep(pairs.mapInArrow(run, ddl), "found")
    close = stage.keep(found.where("other is not null"), "close")
    if not close.isEmpty():
        for node, vector in (("node", "u"), ("root", "v")):
            close = close.join(same.select(F.col("rep").alias(node), F.col("unit").alias(vector)), node)
        run, ddl = _decide(least)
        close = stage.keep(close.select("node", "links", "root", "other", "u", "v").mapInArrow(run, ddl), "decided")
        back = close.select(F.col("root").alias("node"), F.col("other").alias("links"), "root")
        found = found.where("other is null").select("node", "links", "root").unionByName(close.select("node", "links", "root")).unionByName(back)
    parts = connected_components(found.where("node <> root"), stage, "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = same.join(counts, F.col("rep") == F.col("node"), "left").drop("node")
    per = per.join(parts, F.col("rep") == F.col("node"), "left").select(
        "label", "dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = units.join(per, ["label", "dim", "unit"]).select("vec_id", "n_links", "component_id")
    # rows without a usable vector, by the same test
    v = F.col("v")
    usable = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL of embedding_duplicates with its defaults on `embeddings`.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT p.b AS a, r.c FROM r JOIN p ON p.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

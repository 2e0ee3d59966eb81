"""Vector code compression (operator 13): product codes by exact k-means with exponion search.

Components become integers, so distances, sums and means are exact and every run
gives the same codes. In each round a part starts at its entry of the round
before. An entry that is nearer, or as near, lies within twice the distance of
that entry from it, so only the entries in this ball are scanned, from a list
sorted by their distance from the former entry. Codes travel with their vectors
in a table written each round, together with each task's sums; the driver only
holds the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylens.llm.staging import Stage, bound_batches

#: Parts of a vector, entries of a codebook (256 at most, a byte each), rounds, and units of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held to plus and minus this, so that sums over a task stay exact.
LIMIT = 1 << 40
#: Labels whose sums are still broadcast.
FEW_LABELS = 1_000_000
_ROWS = 512


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), held to LIMIT."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, exactly; the kind of a and b is one that holds them."""
    if a.dtype == object:
        return np.array([((b - x) ** 2).sum(1) for x in a], object).reshape(len(a), len(b))
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """Integers as the fastest kind in which squared distances are exact: doubles, longs or Python's integers."""
    most = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    bits = 4 * most * most * max(1, arrays[0].shape[1])
    kind = np.float64 if bits < 2**53 else np.int64 if bits < 2**63 else object
    return [a.astype(kind) for a in arrays]


def exponion(x: np.ndarray, book: np.ndarray, former: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x, of equal ones the first, and the squared distances; former: where to start."""
    x, book = exact(x, book)
    gaps = squared(book, book)
    near = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, near, 1)
    d = ((x - book[former]) ** 2).sum(1)
    out, low = np.zeros(len(x), np.int64), d.copy()
    order = np.argsort(former, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(former[order])) + 1):
        if not len(rows):
            continue
        start = former[rows[0]]
        # |c - start| <= |c - x| + |x - start| <= 2 |x - start| for any c that is not further than start
        reach = np.searchsorted(gaps[start], 4 * d[rows], "right")
        by_reach = np.argsort(reach, kind="stable")
        for lo in range(0, len(rows), _ROWS):
            at = by_reach[lo : lo + _ROWS]
            ball = near[start, : reach[at[-1]]]
            apart = squared(x[rows[at]], book[ball])
            least = apart.min(1)
            out[rows[at]] = np.where(apart == least[:, None], ball, len(book)).min(1)
            low[rows[at]] = least
    return out, low


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end; lengths differ by one at most."""
    edges = [dim * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors without null or non-finite components, as integers of 4 or 8 bytes each."""
    for batch in batches:
        v = batch.column(2)
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = v.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(len(v)), size)
        bad = np.bincount(row[~np.isfinite(x)], minlength=len(v)) > 0  # nulls are read as not numbers
        keep = np.flatnonzero((size > 0) & ~bad)
        made = whole_numbers(np.where(np.isfinite(x), x, 0))
        end = np.cumsum(size)
        kind = np.int32 if np.abs(made).max(initial=0) < 2**31 else np.int64
        made = made.astype(kind)
        body = [made[end[i] - size[i] : end[i]].tobytes() for i in keep]
        index = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(index), batch.column(1).take(index), pa.array(size[keep].astype(np.int32)), pa.array(body, pa.binary())], names=["vec_id", "label", "dim", "x"]
        )


def read(given: pa.Array, dim: int) -> np.ndarray:
    body = given.to_pylist()
    out = np.zeros((len(body), dim), np.int64)
    wide = np.array([len(b) == 8 * dim for b in body], bool)
    for kind, rows in ((np.int64, np.flatnonzero(wide)), (np.int32, np.flatnonzero(~wide))):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(body[i] for i in rows), kind).reshape(len(rows), dim)
    return out


_KINDS = {"vec_id": pa.int64(), "label": pa.string(), "x": pa.binary(), "code": pa.binary(), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64())}
_DDL = "vec_id long, label string, x binary, code binary, error long, part int, entry int, n long, sums array<long>"


def _assign(shared, dim: int, add: bool):
    """Codes and errors of vectors; with add, also each task's counts and sums by part and entry, in rows with a part."""

    def rows(**columns: object) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _KINDS.items()], names=list(_KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        where = cuts(dim, len(books))
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = read(batch.column("x"), dim)
            given = batch.column("code").to_pylist()
            former = np.frombuffer(b"".join(given), np.uint8).reshape(len(x), -1) if given[0] is not None else np.zeros((len(x), len(books)), np.uint8)
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), object)
            for i, (book, (lo, hi)) in enumerate(zip(books, where, strict=True)):
                entry, apart = exponion(x[:, lo:hi], book, former[:, i].astype(np.int64))
                codes[:, i] = entry
                error += apart.astype(np.int64) if apart.dtype != object else apart
                np.add.at(sums[i], entry, x[:, lo:hi])
                counts[i] += np.bincount(entry, minlength=len(book))
            error = np.minimum(error, 2**63 - 1).tolist()
            yield rows(vec_id=batch.column("vec_id"), label=batch.column("label"), x=batch.column("x"), code=[c.tobytes() for c in codes], error=error)
        if add:
            for i, (s, n) in enumerate(zip(sums, counts, strict=True)):
                used = np.flatnonzero(n)
                yield rows(part=np.full(len(used), i), entry=used, n=n[used], sums=s[used].tolist())

    return run


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), codebooks): code has a byte for each part, the index of its entry; entries are integers.

    Rows whose vector is null or empty, or holds null or non-finite components,
    are dropped, and so are those of another length than the first kept vector.
    Codebooks start as the parts of the smallest vec_ids, null ids last, rows
    that share an id in order of their bytes; with fewer rows than `entries`
    they are as short. Of entries at equal distances, as of equal entries, the
    first counts. Repeated rows count each. Lengths that the parts do not divide
    give parts that differ by one. Components are held to LIMIT and errors to
    the largest long. An empty table, or one without usable vectors, gives an
    empty one and no codebooks. Labels are compared as strings. Other columns,
    whatever their names, are ignored.
    """
    spark = embeddings.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    given = embeddings.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    table = stage.keep(given.mapInArrow(_valid, "vec_id long, label string, dim int, x binary"), "integers")
    order = [F.asc_nulls_last("vec_id"), F.asc("x")]
    first = table.orderBy(*order).limit(1).collect()
    if not first:
        return table.select("vec_id", "label", F.col("x").alias("code"), F.lit(0).cast("long").alias("error")), []
    dim = first[0]["dim"]
    table = table.where(F.col("dim") == dim)
    seeds = read(pa.array([bytes(r["x"]) for r in table.orderBy(*order).limit(entries).collect()]), dim)  # `entries` rows
    books = [seeds[:, lo:hi].copy() for lo, hi in cuts(dim, parts)]
    table = table.select("vec_id", "label", "x", F.lit(None).cast("binary").alias("code"))
    for r in range(rounds + 1):
        run = _assign(spark.sparkContext.broadcast(books), dim, r < rounds)
        made = stage.keep(table.select("vec_id", "label", "x", "code").mapInArrow(run, _DDL), "codes", compression="zstd")
        if r:
            stage.drop(last)
        last, table = made, made.where("part is null")
        if r == rounds:
            break
        sums = made.where("part is not null").select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        books = [b.copy() for b in books]
        for s in sums.collect():  # a row for each component of the codebooks
            books[s["part"]][s["entry"], s["at"]] = int(s["s"]) // s["n"]
    return table.select("vec_id", "label", "code", "error"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def code_digests(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): code in hexadecimal, label_error the errors of equal labels."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = Stage(codes.sparkSession).keep(sums, "labels")
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))

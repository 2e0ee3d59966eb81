"""Suffix-array dedup (operator 11): repeated byte strings by external induced sorting.

1. The least hash of the ANCHOR-byte strings inside a window of `width` bytes
   depends on the window alone, so equal windows have equal anchors. Windows in
   a row with one anchor are a piece. Anchors that come once in the corpus are
   counted away, and with them nearly all text that repeats nowhere.
2. The other pieces are told apart by 128-bit hashes of their bytes and counted:
   all windows of a piece with copies are repeated. An anchor under which more
   than HOT different pieces stand would fill one task; its pieces are cut to
   single windows, whose copies are counted likewise.
3. Anchors with a piece that has no copy, and something to repeat it, are dealt
   into shards with a copy of each of their pieces, so that equal windows meet.
   Each shard is one text with its pieces' ends marked, and its suffix and
   common-prefix arrays come from external induced sorting: tuples wait in
   queues on disk, so a shard may be far larger than memory. A window that has
   `width` bytes in common with its neighbour in the array is repeated.
4. Repeated windows go back to the rows of all copies, and their bytes are cut.
"""

from __future__ import annotations

import shutil
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arraylens.llm.shingles import blocks, mix, utf8
from arraylens.llm.staging import Stage, bound_batches, fresh
from arraylens.llm.suffix_sort import MEMORY, Scratch, suffix_array

#: Bytes of the strings that must stand twice.
WIDTH = 400
#: Share of a window that its anchor has.
ANCHOR = 0.64
#: Windows of a piece at most, so that a text of one repeated character is cut.
LONGEST = 1024
#: Different pieces of an anchor that are still sorted in one shard.
HOT = 500
#: Bytes of a shard, about; an anchor's pieces stay together.
SHARD = 64 << 20

_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base & _MASK, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


def string_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each string of k neighbouring bytes."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.append(np.uint64(0), np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), dtype=np.uint64))
    return mix((total[k:] - total[:-k]) * _powers(_INVERSE, n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbouring values, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    b = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    b[: len(x)] = x
    b = b.reshape(-1, w)
    front = np.minimum.accumulate(b, 1).ravel()
    back = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


def pieces(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor, whether it stands at two places) of the pieces of the texts raw[at[i]:at[i+1]]."""
    k = max(1, int(width * ANCHOR))
    body, cut = raw[at[0] : at[-1]], at - at[0]
    strings, w = string_hashes(body, k), width - k + 1
    least = sliding_min(strings, w)
    size = np.diff(cut)
    whole = np.flatnonzero(size >= width)
    n = size[whole] - width + 1  # windows of each text
    if not len(whole):
        return (np.zeros(0, np.int64),) * 5
    before = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(before, n)
    valid = np.repeat(cut[whole], n) + inside
    h = least[valid]
    # places of strings that are some window's least: theirs is the largest of the least ones around
    around = np.full(len(strings) + w - 1, _MASK, np.uint64)
    around[valid + w - 1] = ~h
    places, times = np.unique(strings[~sliding_min(around, w) == strings], return_counts=True)
    new = np.append(True, h[1:] != h[:-1])
    new[before] = True
    run = np.flatnonzero(new)
    along = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    start = np.flatnonzero(along % LONGEST == 0)
    twice = times[np.searchsorted(places, h[start])] > 1
    return np.repeat(whole, n)[start], inside[start], np.diff(np.append(start, len(h))), h[start].view(np.int64), twice


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            rows = batch.column(0).to_numpy()
            for i, j in blocks(at, 1 << 20):
                text, first, n, h, twice = pieces(raw, at[i : j + 1], width)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(rows[i:j][text]), pa.array(first), pa.array(n.astype(np.int32)), pa.array(twice)],
                        names=["anchor", "row", "first", "n", "twice"],
                    )

    return run, "anchor long, row long, first long, n int, twice boolean"


def _digest(x: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(x))


_READ = {"row": pa.int64(), "first": pa.int64(), "n": pa.int32(), "anchor": pa.int64(), "twice": pa.bool_(), "c": pa.int64(), "d": pa.int64()}
_BODY = {"anchor": pa.int64(), "hot": pa.bool_(), "c": pa.int64(), "d": pa.int64(), "bytes": pa.binary()}


def _listed(width: int, kinds: dict, given: tuple[str, ...], keep: bool):
    """Rows for the pieces listed with each text: the fields `given`, the hash of their bytes, and with keep the bytes."""
    ddl = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            body, out, held = memoryview(raw), [], 0
            for row, lo, found in zip(batch.column(0).to_pylist(), at[:-1].tolist(), batch.column(2).to_pylist(), strict=True):
                for p in found:
                    x = bytes(body[lo + p["first"] : lo + p["first"] + p["n"] + width - 1])
                    out.append((*(() if keep else (row,)), *(p[f] for f in given), *_digest(x), *((x,) if keep else ())))
                    held += len(x) if keep else 64
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return run, ", ".join(f"{n} {ddl[t]}" for n, t in kinds.items())


def _windows(width: int):
    """The single windows of pieces: (c, d) of the piece, place in it, and hash of the window."""

    names = ["c", "d", "at", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, d, x in zip(*(y.to_pylist() for y in batch.columns), strict=True):
                got = np.array([_digest(x[i : i + width]) for i in range(len(x) - width + 1)], np.int64).reshape(-1, 2)
                n = len(got)
                out.append((np.full(n, c), np.full(n, d), np.arange(n, dtype=np.int32), *got.T))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return run, "c long, d long, at int, x long, y long"


def runs_of(mark: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))).reshape(-1, 2)


class Shard:
    """Different texts in one file, whose repeated windows are found together."""

    def __init__(self, width: int, **options: int):
        self.width, self.options = width, options
        self.folder = tempfile.mkdtemp()  # of this task alone, and gone with it
        self.file = open(f"{self.folder}/text", "wb+")
        self.ends: dict = {}
        self.size = 0

    def add(self, key: tuple, text: bytes) -> None:
        if key not in self.ends:
            self.file.write(text + b"\0")
            self.size += len(text) + 1
            self.ends[key] = self.size

    def repeated(self) -> Iterator[tuple[tuple, np.ndarray]]:
        """(key, (first, end) of runs) of the texts with windows that also start elsewhere, in the same text or another."""
        self.file.flush()
        scratch = Scratch(self.folder, self.options.get("memory", MEMORY))
        given = np.memmap(self.file, np.uint8, "r", shape=(self.size,))
        text, mark = scratch.array(self.size + 1, np.uint16), scratch.array(self.size + 1, np.bool_)
        ends = np.fromiter(self.ends.values(), np.int64, len(self.ends))
        # characters: 0 the end, 1 behind each text, bytes above
        for lo in range(0, self.size, 1 << 20):
            part = given[lo : lo + (1 << 20)]
            text[lo : lo + len(part)] = part.astype(np.uint16) + np.uint16(2)
        text[ends - 1], text[self.size], mark[:] = 1, 0, False
        sa, common = suffix_array(text, 258, self.width, self.folder, **self.options)
        for lo in range(0, len(sa), 1 << 20):
            deep = np.flatnonzero(common[lo : lo + (1 << 20)] >= self.width) + lo
            mark[sa[deep]] = True
            mark[sa[deep - 1]] = True
        for key, lo, end in zip(self.ends, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if len(found := runs_of(mark[lo : max(lo, end - self.width)])):
                yield key, found

    def close(self) -> None:
        self.file.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _sorted_shards(width: int):
    """A partition's pieces, in shards: those with repeated windows, and the runs of these."""
    names = ["c", "d", "runs"]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def batch_of(found: list) -> pa.RecordBatch:
        runs = [[{"first": int(a), "end": int(b)} for a, b in r] for _, r in found]
        c, d = zip(*(k for k, _ in found), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(runs, kind)], names=names)

    def done(shard: Shard) -> Iterator[pa.RecordBatch]:
        found = []
        for one in shard.repeated():
            found.append(one)
            if len(found) == 4096:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)
        shard.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = last = None
        try:
            for batch in batches:
                for anchor, c, d, x in zip(*(y.to_pylist() for y in batch.columns), strict=True):
                    if shard is not None and shard.size > SHARD and anchor != last:
                        yield from done(shard)
                        shard = None
                    shard = shard or Shard(width)
                    shard.add((c, d), x)
                    last = anchor
            if shard is not None:
                yield from done(shard)
        finally:
            if shard is not None:
                shard.close()

    return run, "c long, d long, runs array<struct<first:int,end:int>>"


def _cut(names: list[str], text_col: str, spans_col: str, added: list[str], width: int):
    """Texts without their repeated bytes."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(names.index(text_col)))
            kept, sizes, gone, all_spans = [], [], [], []
            body = raw.tobytes()
            for lo, hi, found in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(names.index(spans_col)).to_pylist(), strict=True):
                spans, left, place = [], [], lo
                if found:
                    for first, end in sorted((s["first"], s["end"] + width - 1) for s in found):
                        if spans and first <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([first, end])
                for a, b in spans:
                    left.append(body[place : lo + a])
                    place = lo + b
                left.append(body[place:hi])
                kept.append(b"".join(left))
                sizes.append(hi - lo)
                gone.append(sum(b - a for a, b in spans))
                all_spans.append([{"start": a, "end": b} for a, b in spans])
            rest = [batch.column(i) for i, n in enumerate(names) if n != spans_col]
            new = [pa.array(kept, pa.large_binary()).cast(pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(all_spans, kind)]
            yield pa.RecordBatch.from_arrays([*rest, *new], names=[*(n for n in names if n != spans_col), *added])

    return run


def cut_repeats(documents: DataFrame, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """documents with kept (binary), n_bytes, n_removed and removed (array of start and end) added.

    A byte of a text's UTF-8 goes if a string of `width` bytes covers it that
    also starts anywhere else, in the same text or another; strings may overlap
    and are judged on the input. No match runs over the end of a text. Since
    bytes are cut, kept need not be UTF-8. Null texts count as empty; texts
    shorter than width, empty ones among them, keep all bytes; texts of any
    length are cut into pieces of LONGEST windows at most. Equal rows are
    repeats of each other, whatever their other columns hold; there are no ties,
    as every copy goes. An empty table gives an empty one. Columns of the input
    stay; those named as the added ones are replaced.
    """
    spark = documents.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    added = ["kept", "n_bytes", "n_removed", "removed"]
    names = [c for c in documents.columns if c.lower() not in added]
    row_col, spans_col = fresh([*names, *added], "_row", "_spans")
    docs = documents.select(*[f"`{c}`" for c in names]).withColumn(row_col, F.monotonically_increasing_id())
    docs = stage.keep(docs, "documents", compression="zstd")
    texts = docs.select(F.col(row_col).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run, ddl = _anchors(width)
    anchors = stage.keep(texts.mapInArrow(run, ddl), "anchors")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("anchor")
    shared = stage.keep(shared, "shared")
    listed = anchors.join(shared, "anchor", "left_semi")
    listed = listed.groupBy("row").agg(F.collect_list(F.struct("first", "n", "anchor", "twice")).alias("pieces"))
    run, ddl = _listed(width, _READ, ("first", "n", "anchor", "twice"), False)
    read = stage.keep(texts.join(listed.hint("shuffle_hash"), "row").select("row", "text", "pieces").mapInArrow(run, ddl), "pieces")
    stage.drop(anchors, shared)

    places = read.select("row", "first", "n", "c", "d")
    copies = read.groupBy("anchor", "c", "d").agg(
        F.count("*").alias("copies"), F.max("n").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("row", "first")).alias("at")
    )
    copies = stage.keep(copies, "copies")
    # all windows of a piece with copies are repeated; one without can only repeat itself or another piece of its anchor
    per = copies.groupBy("anchor").agg(F.count("*").alias("c"), F.min("copies").alias("least"), F.max("twice").alias("t"))
    per = per.where("least = 1 and (c > 1 or t)").select("anchor", (F.col("c") > HOT).alias("hot"))
    # one copy of each piece of these anchors is read again, from the text that has it first
    wanted = copies.join(stage.keep(per, "open"), "anchor")
    wanted = wanted.groupBy("at.row").agg(F.collect_list(F.struct("at.first", "n", "anchor", "hot")).alias("pieces"))
    run, ddl = _listed(width, _BODY, ("anchor", "hot"), True)
    bodies = texts.join(wanted.hint("shuffle_hash"), "row").select("row", "text", "pieces").mapInArrow(run, ddl)
    bodies = stage.keep(bodies, "bodies", compression="zstd")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a count, so that small partitions are not joined to large shards
    cool = bodies.where("not hot").select("anchor", "c", "d", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor")
    run, ddl = _sorted_shards(width)
    marks = cool.mapInArrow(run, ddl)
    run, ddl = _windows(width)
    single = stage.keep(bodies.where("hot").select("c", "d", "bytes").mapInArrow(run, ddl), "windows")
    # kept, so that the rows of a common window can be split over tasks where they meet it
    again = stage.keep(single.groupBy("x", "y").agg(F.count("*").alias("k")).where("k > 1").select("x", "y"), "again")
    single = single.join(again, ["x", "y"], "left_semi").select("c", "d", F.struct(F.col("at").alias("first"), (F.col("at") + 1).alias("end")).alias("r"))
    marks = marks.unionByName(single.groupBy("c", "d").agg(F.sort_array(F.collect_list("r")).alias("runs")))
    whole = copies.where("copies > 1").select("c", "d", F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("end"))).alias("runs"))
    marks = stage.keep(marks.join(whole.select("c", "d"), ["c", "d"], "left_anti").unionByName(whole), "marks")
    spans = places.join(marks, ["c", "d"]).select("row", F.transform("runs", lambda r: F.struct((F.col("first") + r["first"]).alias("first"), (F.col("first") + r["end"]).alias("end"))).alias("runs"))
    spans = stage.keep(spans.groupBy(F.col("row").alias(row_col)).agg(F.flatten(F.collect_list("runs")).alias(spans_col)), "spans")
    out = docs.join(spans.hint("shuffle_hash"), row_col, "left").drop(row_col)
    run = _cut(out.columns, text_col, spans_col, added, width)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    more = [T.StructField(c, t) for c, t in zip(added, (T.BinaryType(), T.LongType(), T.LongType(), span), strict=True)]
    fields = [f for f in out.schema if f.name != spans_col]
    return out.mapInArrow(run, T.StructType([*fields, *more]))


#: DuckDB SQL of op11 on `documents`: every 400-byte string by its hexadecimal form.
ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, row, x, length(x) // 2 AS n FROM d),
w AS (SELECT row, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT row, x, unnest(range(0, n - 399)) AS i FROM b WHERE n >= 400)),
r AS (SELECT row, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT row, min(i) AS a, max(i) + 400 AS z FROM (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS k FROM g) GROUP BY row, k),
k AS (SELECT row, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS f, a, z FROM s),
t AS (SELECT row, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail FROM s GROUP BY row),
h AS (SELECT b.row, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS y FROM k JOIN b USING (row) GROUP BY b.row)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN y IS NULL THEN x ELSE y || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM b LEFT JOIN t USING (row) LEFT JOIN h USING (row)
"""

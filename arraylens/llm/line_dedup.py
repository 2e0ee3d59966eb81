"""Line dedup (operator 1): a suffix array over line ids by distributed prefix doubling.

Every document is a sequence of 128-bit line ids, ended by a mark of its own, and
every line starts a suffix. Round r ranks suffixes by their first 2^r lines:
equal pairs of ranks (of the line and of the line 2^(r-1) below it) are counted,
put in order by a range-partitioned sort and numbered. Suffixes whose rank is
unique are in place and leave, so only repeated lines are moved after round 0;
rounds go on until every suffix is in place.

Suffixes that share their first m lines are an interval of the array with a
longest common prefix of m or more; two overlapping ranks name it for any m. A
repeated run counts once it has `min_words` words. The shortest such window that
starts at a line, and the shortest that ends at one, name the intervals that
matter, and lie in every repeated run of that size. In each interval the first
window in corpus order is the original. A later one is extended to the maximal
run that it shares with its original, by the ranks from the longest to the
shortest: windows that only go on with a run from the line above them are not
extended again. The lines of these runs are deleted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arraylens.llm.staging import Stage, bound_batches, fresh

#: Words that a repeated run has at least. Half of 50, for passages that share their edge lines with other text.
MIN_WORDS = 25


def line_id(line: str) -> tuple[int, int, int]:
    """128-bit hash of a line with its white space collapsed, as two longs, and its words; zeros for a blank one."""
    w = line.split()
    if not w:
        return 0, 0, 0
    a, b = struct.unpack("<qq", xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")))
    return a, b, len(w)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest window of `least` words that starts at each line, and that ends at it; 0 where none does."""
    total = np.append(0, np.cumsum(words))
    n = len(words)
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least, "left")
    down = np.where(end <= n, end - at, 0)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    up = np.where(total[1:] >= least, at + 1 - start, 0)
    return down, up


def _lines(least: int):
    names = ["row", "at", "id", "more", "down", "up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[] for _ in names]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [x for x in map(line_id, (text or "").split("\n")) if x[2]]
                if not ids:
                    continue
                h, more, w = np.array(ids, np.int64).T
                down, up = windows(w, least)
                for p, x in zip(parts, (np.full(len(h), row), np.arange(len(h)), h, more, down, up), strict=True):
                    p.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], names=names)

    return run, ", ".join(f"{n} long" for n in names)


def _cut(names: list[str], text_col: str, spans_col: str):
    """Texts without the lines of their spans; what a batch has besides stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone, runs = [], [], [], []
            spans = batch.column(names.index(spans_col)).to_pylist()
            for text, found in zip(batch.column(names.index(text_col)).to_pylist(), spans, strict=True):
                lines = [] if text is None else text.split("\n")
                total.append(len(lines))
                if not found:
                    texts.append(text), gone.append(0), runs.append([])
                    continue
                full = [i for i, x in enumerate(lines) if x.split()]
                mark = np.zeros(len(full) + 1, np.int64)
                for s in found:
                    mark[s["at"]] += 1
                    mark[s["at"] + s["n"]] -= 1
                out = np.zeros(len(lines), bool)
                dead = np.cumsum(mark[:-1]) > 0
                out[np.array(full)[dead]] = True
                for i, x in enumerate(lines):  # a blank line goes with the line above it
                    if not out[i] and i and out[i - 1] and not x.split():
                        out[i] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                runs.append([{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)])
                texts.append("\n".join(x for i, x in enumerate(lines) if not out[i]))
                gone.append(int(out.sum()))
            kept = [batch.column(i) for i, n in enumerate(names) if n not in (text_col, spans_col)]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            new = [pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(runs, kind)]
            more = [text_col, "_lines", "_removed", "_runs"]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(n for n in names if n not in (text_col, spans_col)), *more])

    return run


def common_runs(pairs: DataFrame, levels: list[DataFrame], stage: Stage) -> DataFrame:
    """pairs (row, at, o_row, o_at) with n, the number of lines that are equal from both places on.

    Every third level is written: a plan of all joins is large, and the driver makes it anew as each of its stages ends.
    """
    at = pairs.withColumn("n", F.lit(0).cast("long"))
    for r in reversed(range(len(levels))):
        one = levels[r].select("row", F.col("at").alias("_at"), "rank")
        two = levels[r].select(F.col("row").alias("o_row"), F.col("at").alias("_o"), F.col("rank").alias("_rank"))
        at = at.withColumn("_at", F.col("at") + F.col("n")).join(one, ["row", "_at"], "left")
        at = at.withColumn("_o", F.col("o_at") + F.col("n")).join(two, ["o_row", "_o"], "left")
        step = F.when(F.col("rank") == F.col("_rank"), 1 << r).otherwise(0)
        at = at.select("row", "at", "o_row", "o_at", (F.col("n") + step).alias("n"))
        if r % 3 == 0 and r:
            at = stage.keep(at, "runs")
    return at


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with later copies of repeated line runs deleted from `text`, and _lines, _removed and _runs added.

    Lines are split at U+000A and equal when their words are; blank lines never
    count and go with a deleted line above them. Of each run of lines with
    min_words words or more that stands several times, within a document or in
    several, the copy in the row with the smallest doc_id (null first), on ties
    the first row read, and there the topmost, stays. _lines counts a text's
    lines, _removed those deleted and _runs gives their first and last numbers.
    Null and empty texts stay as they are; a text all of whose lines are later
    copies becomes empty; a text of any length is one sequence of rows. Columns
    of other names are kept, those of these three names replaced; an empty table
    stays empty. The input is read once and written with row numbers, so any
    plan may have made it.
    """
    spark = documents.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    names = [c for c in documents.columns if c not in ("_lines", "_removed", "_runs")]
    row_col, spans_col = fresh([*names, "_lines", "_removed", "_runs"], "_row", "_spans")
    docs = documents.select(*[f"`{c}`" for c in names]).withColumn(row_col, F.monotonically_increasing_id())
    docs = stage.keep(docs, "documents", compression="zstd")
    run, ddl = _lines(min_words)
    texts = docs.select(F.col(row_col).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = texts.mapInArrow(run, ddl)
    lines = stage.keep(lines, "lines")

    # round 0: ids of lines that stand twice at least, in order
    def ranked(pairs: DataFrame) -> DataFrame:
        """Numbers the distinct pairs x, y in order; pairs that stand once get none."""
        twice = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
        order = twice.repartitionByRange("x", "y").sortWithinPartitions("x", "y")  # no count: late rounds are small and take few tasks
        return stage.keep(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")

    level = lines.select("row", "at", F.col("id").alias("x"), F.col("more").alias("y"))
    levels: list[DataFrame] = []
    while True:
        r = len(levels)
        if r:
            below = levels[-1].select("row", (F.col("at") - (1 << (r - 1))).alias("at"), F.col("rank").alias("y"))
            level = levels[-1].withColumnRenamed("rank", "x").join(below, ["row", "at"])
        ranks = ranked(level)
        got = stage.keep(level.join(ranks, ["x", "y"]).select("row", "at", "rank"), f"level{r}")
        stage.drop(ranks)
        if got.isEmpty():
            break
        levels.append(got)
    if not levels:
        levels = [got]

    # windows, named by the ranks of their first and last 2^k lines
    wins = lines.where("down > 0").select("row", "at", F.col("down").alias("n"))
    wins = wins.unionByName(lines.where("up > 0").select("row", (F.col("at") - F.col("up") + 1).alias("at"), F.col("up").alias("n")))
    k = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    every = None
    for r, t in enumerate(levels[: min_words.bit_length()]):  # a window has min_words lines at most
        one = t.select(F.lit(r).alias("k"), "row", "at", "rank")
        every = one if every is None else every.unionByName(one)
    first = every.withColumnRenamed("rank", "x")
    last = every.withColumnRenamed("rank", "y").withColumnRenamed("at", "end")
    wins = wins.distinct().withColumn("k", k).join(first, ["k", "row", "at"])
    wins = wins.withColumn("end", F.col("at") + F.col("n") - F.expr("shiftleft(1, k)")).join(last, ["k", "row", "end"])
    order = docs.select(F.col(row_col).alias("row"), F.col(f"`{id_col}`").alias("doc"))
    wins = stage.keep(wins.join(order, "row").select("row", "doc", "at", "n", "x", "y"), "windows")
    place = F.struct("doc", "row", "at")
    # kept, so that the join reads two tables and a common passage's rows can be split over tasks
    original = wins.groupBy("n", "x", "y").agg(F.min(place).alias("o"), F.count("*").alias("c")).where("c > 1").drop("c")
    original = stage.keep(original, "originals")
    later = wins.join(original, ["n", "x", "y"]).where(place > F.col("o"))
    later = stage.keep(later.select("row", "at", F.col("o.row").alias("o_row"), F.col("o.at").alias("o_at")).distinct(), "later")
    # a window whose lines go on with the run of the window above it is in that run
    above = later.select("row", (F.col("at") + 1).alias("at"), "o_row", (F.col("o_at") + 1).alias("o_at"))
    heads = stage.keep(later.join(above, ["row", "at", "o_row", "o_at"], "left_anti"), "heads")
    runs = common_runs(heads, levels, stage)
    spans = runs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias(spans_col))
    spans = stage.keep(spans, "spans")
    stage.only(docs, spans)
    # spans grow with the input: hashed by row, which no key can skew, and texts are not sorted
    out = docs.join(spans.withColumnRenamed("row", row_col).hint("shuffle_hash"), row_col, "left").drop(row_col)
    fields = [f for f in documents.select(*[f"`{c}`" for c in names]).schema if f.name != text_col]
    run_type = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    fields += [T.StructField(text_col, T.StringType()), T.StructField("_lines", T.IntegerType()), T.StructField("_removed", T.IntegerType())]
    done = out.mapInArrow(_cut(out.columns, text_col, spans_col), T.StructType([*fields, T.StructField("_runs", run_type)]))
    return done.select(*[f"`{c}`" for c in names], "_lines", "_removed", "_runs")

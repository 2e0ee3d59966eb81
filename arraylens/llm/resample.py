"""Target-distribution importance resampling (operator 12) over hashed word n-grams.

Bytes of the Arrow UTF-8 buffer are classified by a lookup table, and words lie
between the places where the class changes. The CRC of all n-grams is advanced
for all words at once, one byte a step: through each word, then over a space and
through the word behind it, then once more. Buckets of the target and of the raw
texts are counted in tables of fixed size, so a bucket's gain is a number known
to all tasks; a text's weight is the sum over its features. Gumbel noise from a
hash of the id turns the weights into a draw without replacement: the highest
sums are drawn, and ranks come from one range-partitioned sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arraylens.llm.shingles import blocks, utf8
from arraylens.llm.staging import Stage, bound_batches, fresh

BUCKETS = 10_000
#: Words of the longest n-gram, words of a text that may be drawn, share drawn in per cent, and seed of the noise.
GRAMS, LEAST_WORDS, PERCENT, SEED = 3, 20, 5, 42
#: Words still open in a step, below which each is finished by itself.
FEW = 24
#: Bytes of text cut into words at once.
BLOCK = 1 << 19

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # after lower-casing


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """Inner CRC states one byte on."""
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def through(state: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inner CRC states after body[start : start + size] each."""
    order = np.argsort(-size, kind="stable")
    open_at, s, left = start[order], state[order], size[order]
    # words with more than k bytes are the first `reach[k]`
    reach = len(left) - np.cumsum(np.bincount(left, minlength=1))
    k = 0
    while k < len(reach) and reach[k] > FEW:
        m = reach[k]
        s[:m] = step(s[:m], body[open_at[:m] + k].astype(np.uint32))
        k += 1
    if k < len(reach):
        for i in range(reach[k]):  # a few long words
            rest = body[open_at[i] + k : open_at[i] + left[i]].tobytes()
            s[i] = zlib.crc32(rest, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(raw: np.ndarray, at: np.ndarray, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, CRC) of each n-gram of up to `grams` words of the texts raw[at[i]:at[i+1]], and their numbers of words."""
    cut = at - at[0]
    body = _LOW[raw[at[0] : at[-1]]]
    inside = _WORD[body]
    before = np.append(False, inside[:-1])
    behind = np.append(inside[1:], False)
    edge = cut[1:-1][(cut[1:-1] > 0) & (cut[1:-1] < len(body))]
    before[edge] = False
    behind[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    size = np.flatnonzero(inside & ~behind) + 1 - start
    text = np.searchsorted(cut, start, "right") - 1
    words = np.bincount(text, minlength=len(cut) - 1)
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    texts, crcs = [], []
    for n in range(min(grams, len(start))):
        k = len(start) - n
        if n:
            state = step(state[:k], np.uint32(0x20))
        state = through(state, body, start[n:], size[n:])
        same = text[n:] == text[:k]
        texts.append(text[:k][same])
        crcs.append(~state[same])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), words
    return np.concatenate(texts), np.concatenate(crcs), words


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features in each bucket, once a task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        raw, at = utf8(batch.column(0))
        for i, j in blocks(at, BLOCK):
            total += np.bincount(features(raw, at[i : j + 1])[1] % np.uint32(BUCKETS), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts (one column) by bucket: BUCKETS numbers, whatever the input."""
    rows = texts.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in the target and the raw texts, both smoothed by one."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))))


def _weights(shared):
    names = ["row", "doc_id", "n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            made = []
            for i, j in blocks(at, BLOCK):
                text, crc, words = features(raw, at[i : j + 1])
                gain = shared.value[crc % np.uint32(BUCKETS)]
                made.append((words, np.bincount(text, minlength=j - i), np.bincount(text, gain, j - i)))
            if made:
                numbers = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers], names=names)

    return run, ", ".join(f"{n} long" for n in names)


def ranked(scored: DataFrame, stage: Stage, percent: int, least: int) -> DataFrame:
    """scored with rank, from 1, of the highest scores: percent of the rows with `least` words; null for the others.

    One range-partitioned sort; rows are numbered within partitions and shifted by those before.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    may = scored.where(F.col("n_words") >= least)
    parts = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
    put = may.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    put = stage.keep(put.withColumn("_part", F.shiftright("_seq", 33)), "sorted")
    sizes = put.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_lo"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage.keep(sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") + 1).alias("_shift"), "_n"), "sizes")
    drawn = percent * (sizes.agg(F.sum("_n")).first()[0] or 0) // 100
    at = F.col("_seq") + F.col("_shift")
    put = put.join(F.broadcast(sizes.drop("_n")), "_part").withColumn("rank", F.when(at <= drawn, at))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return put.select(rest.columns).unionByName(rest)


def importance(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of each row of documents, against the texts of target.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased;
    features all runs of one to three words. Null and empty texts and those
    without words have no features, weight 0 and are never drawn. Texts of any
    length are read whole. Equal scores are drawn in order of doc_id, null ids
    last; the noise of a null id is that of an empty one. Rows that share a
    doc_id share its noise and are drawn each for itself. Without documents or
    words nothing is drawn; an empty target leaves smoothed shares. Other
    columns, whatever their names, are ignored. row names a column that numbers
    the rows; without it they are numbered as read.
    """
    spark = documents.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    text = F.col("`text`").cast("string")
    table = gains(bucket_counts(documents.select(text)), bucket_counts(target.select(text)))
    shared = spark.sparkContext.broadcast(table)
    run, ddl = _weights(shared)
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    scored = documents.select(number.alias("row"), F.col("`doc_id`").cast("long").alias("doc_id"), text).mapInArrow(run, ddl)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stage.keep(scored.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    return ranked(scored, stage, percent, least)


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of documents, all columns, with their rank (a column of that name is replaced); see importance."""
    names = [c for c in documents.columns if c.lower() != "rank"]
    (row,) = fresh([*names, "rank"], "_row")
    docs = Stage(documents.sparkSession).keep(documents.select(*[f"`{c}`" for c in names], F.monotonically_increasing_id().alias(row)), "documents", compression="zstd")
    drawn = importance(docs, target, percent, least, seed, row).where("rank is not null").select(F.col("row").alias(row), "rank")
    return docs.join(drawn, row).drop(row)

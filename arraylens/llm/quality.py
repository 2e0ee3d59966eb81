"""Quality classifier (operator 10): histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled rows and kept
as flat arrays in heap order, so that numpy walks all rows of a batch through a
tree at once, one step a level. Statistics look at whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arraylens.llm.shingles import blocks, join_words, utf8, words
from arraylens.llm.staging import bound_batches, with_text

#: Most labelled rows that trees are grown on; beyond it the rows with the smallest id hashes are taken.
TRAIN_ROWS = 20_000

_CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "pause", "exclaim", "bracket", "symbol", "high"]


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.int64)
    for name, chars in {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r\f\v", "newline": b"\n",
        "stop": b".", "pause": b",;:'-", "exclaim": b"!?", "bracket": b"()[]{}<>\"", "high": range(128, 256),
    }.items():
        table[list(chars)] = _CLASSES.index(name)
    return table


_TABLE = _class_table()
#: Names of the statistics, in the order of their columns.
STATISTICS = [
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "mean_word", "sd_word", "log_longest_word", "distinct_words",
    "top_word", "second_word", "repeated_5grams", "repeated_2grams", "words_a_line", "shifts", "log_lines",
]


def _repeats(h: np.ndarray) -> tuple[float, float, float]:
    """Share of distinct values and of the two most frequent ones."""
    if not len(h):
        return 1.0, 0.0, 0.0
    h = np.sort(h)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    n = np.diff(np.append(at, len(h)))
    top = np.partition(n, -2)[-2:] if len(n) > 1 else np.array([0, n[0]])
    return len(n) / len(h), top[1] / len(h), top[0] / len(h)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; null and empty texts alike."""
    raw, at = utf8(column)
    out = np.zeros((len(at) - 1, len(STATISTICS)))
    k = len(_CLASSES)
    for i, j in blocks(at):
        sizes = np.diff(at[i : j + 1])
        body = raw[at[i] : at[j]]
        kind = _TABLE[body]
        owner = np.repeat(np.arange(j - i), sizes)
        counts = np.bincount(owner * k + kind, minlength=(j - i) * k).reshape(j - i, k)
        # changes between kinds of characters, a mark of noise
        moved = np.append(False, kind[1:] != kind[:-1])[: len(body)]
        moved[(at[i:j] - at[i])[sizes > 0]] = False
        shifts = np.bincount(owner, moved, minlength=j - i)
        w, before = words(raw, at[i : j + 1])
        inside = kind != _CLASSES.index("space")
        inside &= kind != _CLASSES.index("newline")
        first = inside & ~np.append(False, inside[:-1])
        cut = at[i:j] - at[i]
        cut = cut[cut < len(body)]
        first[cut] = inside[cut]
        starts = np.flatnonzero(first)
        letters = np.add.reduceat(inside, starts) if len(starts) else np.zeros(0)
        for d in range(j - i):
            a, b = before[d], before[d + 1]
            n, m = sizes[d], b - a
            row = out[i + d]
            row[:k] = counts[d] / max(n, 1)
            row[k : k + 2] = np.log1p(n), np.log1p(m)
            if m:
                x = letters[a:b]
                row[k + 2 : k + 5] = x.mean(), x.std(), np.log1p(x.max())
            row[k + 5 : k + 8] = _repeats(w[a:b])
            row[k + 8] = 1 - _repeats(join_words(w[a:b], 5))[0]
            row[k + 9] = 1 - _repeats(join_words(w[a:b], 2))[0]
            lines = counts[d, 4] + 1
            row[k + 10 : k + 13] = np.log1p(m / lines), shifts[d] / max(n, 1), np.log1p(lines)
    return out


@dataclass
class Trees:
    """Trees of equal depth in heap order: node n has the children 2n + 1 and 2n + 2."""

    feature: np.ndarray  # (trees, inner nodes) int
    threshold: np.ndarray  # (trees, inner nodes); a row goes right if its value is larger
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: int = 8
) -> Trees:
    """Boosted trees on the logistic loss; splits are chosen on histograms of quantile bins."""
    n, k = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip((y.sum() + 1) / (n + 2), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, bins + 1)[1:-1])) for c in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, c], "left") for c, e in enumerate(edges)])
    flat = binned + np.arange(k) * bins
    total = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cut = np.full(inner, bins, np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            key = ((node - low)[:, None] * (k * bins) + flat).ravel()
            size = width * k * bins
            G = np.bincount(key, np.repeat(g, k), size).reshape(width, k, bins).cumsum(2)
            H = np.bincount(key, np.repeat(h, k), size).reshape(width, k, bins).cumsum(2)
            N = np.bincount(key, minlength=size).reshape(width, k, bins).cumsum(2)
            Ga, Ha, Na = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
            gain = G**2 / (H + smooth) + (Ga - G) ** 2 / (Ha - H + smooth) - Ga**2 / (Ha + smooth)
            gain[(N < least) | (Na - N < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                c, b = divmod(int(best[i]), bins)
                if gain[i, c, b] > 1e-6 and b < len(edges[c]):
                    f[low + i], t[low + i], cut[low + i] = c, edges[c][b], b
            node = 2 * node + 1 + (binned[np.arange(n), f[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + smooth)
        total += leaf[at]
        features.append(f), thresholds.append(t), values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


def held_out(doc_id: Column, mod: int = 5, rest: int = 0) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the labelled documents that are not held out.

    Labels that are null, or whose id is null, are left out; an id with several
    labels counts by their mean. Texts are found by a broadcast of `rows` ids at
    most, and of rows that share an id only the one with the least statistics
    counts, so that no more than `rows` rows of numbers reach the driver.
    Without labels every text gets 0.5. Null and empty texts count as empty
    ones, texts of any length are read whole, and the order of rows and ties do
    not matter. An empty table trains as one without labels.
    """
    bound_batches(documents.sparkSession)
    y = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    y = y.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    docs = with_text(documents).join(F.broadcast(y), F.col("doc_id") == F.col("label_id")).select("text", "y", "label_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            packed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([packed, batch.column(1), batch.column(2)], names=["x", "y", "id"])

    found = docs.mapInArrow(run, "x array<double>, y double, id long").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, len(STATISTICS))
    y = found.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # rows come in any order
    return fit(x[order], y[order])


def score(documents: DataFrame, model: Trees, out: str = "score", text_col: str = "text") -> DataFrame:
    """documents with a probability of quality 1 in the column `out`, which replaces one of that name; all others stay.

    Null and empty texts are scored as empty, texts of any length whole, and
    repeated rows alike; an empty table stays empty.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    documents = documents.drop(out) if out in documents.columns else documents
    shared = spark.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(statistics(batch.column(names.index(text_col)).cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, out])

    return documents.mapInArrow(run, T.StructType([*documents.schema, T.StructField(out, T.DoubleType())]))


def quality(documents: DataFrame, labels: DataFrame, least: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row: predicted is 1 where the score is `least` or more.

    Every row is scored on its whole text alone: repeated rows score alike, null
    texts as empty ones, null ids are not held out. Columns other than doc_id and
    text are not read.
    """
    docs = score(with_text(documents), train(documents, labels, rows))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )

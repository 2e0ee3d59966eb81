"""Language identification (operator 5) by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams by rank. A text gets the
language whose profile has the smallest out-of-place distance: the sum over the
text's own most frequent n-grams of the difference of ranks, or the largest
difference for n-grams that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arraylens.llm.quality import held_out
from arraylens.llm.staging import bound_batches, with_text

#: N-grams of a profile.
RANKS = 300
#: Counted n-grams that a task holds before it hands them on.
HELD = 1 << 19

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The 1-, 2- and 3-grams of a text's words in lower case, 21 bits a character; empty without letters.

    Whatever is no letter parts words; a space stands before and after each word.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(letters()[c], c, 32)
    c = np.concatenate([[32], c, [32]])
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = c[:-2] << 42 | two[1:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[at], np.diff(np.append(at, len(g)))


def ranked(g: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, smaller ones first on ties."""
    keys, n = counted(g)
    if len(keys) > ranks:
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))][:ranks]


@dataclass
class Profiles:
    names: list[str]
    keys: list[np.ndarray]  # sorted n-grams of each language
    ranks: list[np.ndarray]  # and their ranks
    size: int

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest distance; `und` and 0 without letters or profiles."""
        g = ranked(grams(text), self.size) if text else ()
        if not len(g) or not self.names:
            return "und", 0.0
        mine = np.arange(len(g))
        best, score = "und", -1.0
        for name, keys, ranks in zip(self.names, self.keys, self.ranks, strict=True):
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            apart = np.where(keys[i] == g, np.abs(ranks[i] - mine), self.size)
            s = 1 - apart.sum() / (self.size * len(g))
            if s > score:
                best, score = name, s
        return best, float(score)


def train(documents: DataFrame, ranks: int = RANKS) -> Profiles:
    """Profiles from all documents with text and lang that are not held out (crc32(doc_id) mod 4 = 2).

    Tasks hand on counts of n-grams, not texts; the driver gets `ranks` rows a language.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"), 4, 2))
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in parts])
            n = np.concatenate([n for _, n in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[at], np.add.reduceat(n, at) if len(at) else n

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = merge(parts)
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int32)), [lang]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                held.setdefault(lang, []).append(counted(np.concatenate(parts)))
                if len(held[lang]) > 8:
                    held[lang] = [merge(held[lang])]
            if sum(len(k) for x in held.values() for k, _ in x) > HELD:
                yield from flush()
        yield from flush()

    counts = docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(first) - 1).where(F.col("rank") < ranks)
    by: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "rank").collect():
        by.setdefault(r["lang"], []).append((r["gram"], r["rank"]))
    names = sorted(by)
    tables = [np.array(sorted(by[x]), np.int64) for x in names]
    return Profiles(names, [t[:, 0] for t in tables], [t[:, 1] for t in tables], ranks)


def identify(documents: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, from its whole text alone.

    `und` with score 0 where the text is null or has no letter, and where nothing
    could be learned. Ties between languages go to the first name. Repeated rows
    are classified alike; null ids are not held out; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(train(documents, ranks))
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.classify(t) for t in batch.column(1).to_pylist()]
            names, scores = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, scores], names=["doc_id", "lang_pred", "score"])

    out = with_text(documents).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")

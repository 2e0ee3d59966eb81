"""Benchmark decontamination (operator 3): size-partitioned MinHash containment search.

An item of n shingles is contained where a document has ceil(c * n) of them or
more. Of the item's shingles, those with the smallest hash values are its
sketch: as many as n - ceil(c * n) + 1, so a document that lacks the whole
sketch lacks too many shingles to contain the item. Items are partitioned by
size, by powers of two. Each partition has one table of its sketch values and
their largest one, which bounds the sketch of documents too: only a document's
shingles up to that value are looked up in the table, and none if the document
has fewer shingles than the partition's least need. The cost of a document thus
follows its own length and not the number of items. Each hit is verified by
exact containment of all the item's shingles. Nothing is lost to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arraylens.llm.shingles import blocks, join_words, shingle_sets, utf8, words
from arraylens.llm.staging import Stage, bound_batches, with_text

#: Most shingles of all items that tasks get as one broadcast table (16 bytes each); above it items are joined by shuffle.
BROADCAST_SHINGLES = 1 << 21


def runs(column: pa.Array, lengths: list[int]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word runs of the given lengths.

    A run of fewer than the usual words hashes as a short text's only shingle does.
    """
    usual = max(lengths)
    raw, at = utf8(column)
    for i, j in blocks(at):
        w, before = words(raw, at[i : j + 1])
        by = {k: join_words(w, k) for k in lengths}
        for a, b in zip(before[:-1], before[1:], strict=True):
            parts = []
            for k in lengths:
                if b - a >= k:
                    x = by[k][a : b - k + 1]
                    parts.append(x if k == usual else x ^ np.uint64(k))
            x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            yield x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """(item, n, words, shingle) of each distinct item; words: length of its shingles, below k for short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            n = np.array([len(x) for x in sets], np.int64)
            raw, at = utf8(batch.column(1))
            _, before = words(raw, at)
            lengths = np.minimum(np.diff(before), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(batch.column(0), pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n)),
                    pa.array(np.repeat(lengths, n).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)),
                ],
                names=["item", "n", "words", "shingle"],
            )

    return items.mapInArrow(run, "item long, n long, words int, shingle long")


def partitions(shingle: np.ndarray, owner: np.ndarray, n: np.ndarray, needs: np.ndarray) -> list[tuple]:
    """By powers of two of the items' sizes: (least need, sorted sketch values, where each one's items start, items)."""
    out = []
    part = np.frexp(n)[1]
    for c in np.unique(part):
        mine = part[owner] == c
        order = np.lexsort((owner[mine], shingle[mine]))
        values, at = np.unique(shingle[mine][order], return_index=True)
        out.append((int(needs[part == c].min()), values, np.append(at, len(order)), owner[mine][order]))
    return out


def candidates(s: np.ndarray, tables: list[tuple]) -> np.ndarray:
    """Items that share a sketch value with the sorted set s of a document's shingles."""
    found = []
    for least, values, at, items in tables:
        if len(s) < least:
            continue
        low = s[: np.searchsorted(s, values[-1], "right")]
        place = np.searchsorted(values, low)  # below len(values), as no value of low is above the last
        for i in place[values[place] == low]:
            found.append(items[at[i] : at[i + 1]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def find_leaks(
    documents: DataFrame, items: DataFrame, k: int = 5, num: int = 4, den: int = 5, doc_col: str = "doc_id", item_col: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) where a document holds num/den or more of an item's distinct k-word shingles.

    Words are compared as in the n-gram join. Items of fewer than k words count as one run
    of their words, wherever it stands in a document. Items and documents that are
    null, empty or blank match nothing, nor do null ids; repeated rows of either
    table give one row for each pair of ids, with the largest overlap; other
    columns are ignored.
    """
    spark = documents.sparkSession
    stage = Stage(spark)
    bound_batches(spark)
    docs = with_text(documents, doc_col).where("doc_id is not null and text is not null")
    given = with_text(items, item_col).where("doc_id is not null and text is not null").distinct()
    # a repeated id with another text is another item
    given = given.select(F.col("doc_id").alias("item_id"), "text", F.xxhash64("doc_id", "text").alias("item"))
    table = stage.keep(item_shingles(given.select("item", "text"), k), "items")
    lengths = [r["words"] for r in table.select("words").distinct().orderBy("words").collect()]  # k rows at most
    need = F.ceil(F.lit(num) * F.col("n") / F.lit(den))
    if not lengths:
        found = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item"), *[F.lit(0).cast("long").alias(c) for c in ("n_item", "n_shared")])
    elif table.count() <= BROADCAST_SHINGLES:
        # read by the driver as its size is checked
        t = table.orderBy("item", "shingle").toArrow()
        item, shingle = t.column("item").to_numpy(), t.column("shingle").to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        n = np.diff(np.append(starts, len(item)))
        owner = np.repeat(np.arange(len(n)), n)
        needs = -(-num * n // den)
        order = np.lexsort((shingle, owner))
        place = np.arange(len(owner)) - starts[owner]
        sketch = order[place <= (n - needs)[owner]]  # the n - need + 1 smallest of each item, by size
        tables = partitions(shingle[sketch], owner[sketch], n, needs)
        shared = spark.sparkContext.broadcast((tables, shingle, starts, n, needs, item[starts]))
        usual = max(lengths)
        several = [*lengths] if usual == k else [*lengths, k]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, all_shingles, first, size, least, names = shared.value
            for batch in batches:
                rows = []
                for doc, s in zip(batch.column(0).to_pylist(), runs(batch.column(1), several), strict=True):
                    for i in candidates(s, tables):
                        own = all_shingles[first[i] : first[i] + size[i]]
                        at_own = np.minimum(np.searchsorted(s, own), len(s) - 1)
                        both = int(np.count_nonzero(s[at_own] == own))
                        if both >= least[i]:
                            rows.append((doc, names[i], size[i], both))
                made = np.array(rows, np.int64).reshape(len(rows), 4)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made.T], names=["doc_id", "item", "n_item", "n_shared"])

        found = docs.mapInArrow(run, "doc_id long, item long, n_item long, n_shared long")
    else:
        several = sorted({*lengths, k})

        def listed(least: int, most: int):
            """All shingles of each document up to `most`, of documents with `least` or more."""

            def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    docs_, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                    for doc, s in zip(batch.column(0).to_pylist(), runs(batch.column(1), several), strict=True):
                        if len(s) >= least:
                            s = s[: np.searchsorted(s, np.uint64(most), "right")]
                            docs_.append(np.full(len(s), doc, np.int64)), parts.append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs_)), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "shingle"])

            return run_all

        ddl = "doc_id long, shingle long"
        sketches = table.withColumn("u", F.col("shingle").bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
        place = F.row_number().over(Window.partitionBy("item").orderBy("u"))
        sketches = sketches.withColumn("place", place).where(F.col("place") <= F.col("n") - need + 1)
        sketches = stage.keep(sketches.select("item", "shingle", "u", F.floor(F.log2("n")).cast("int").alias("part"), need.alias("need")), "sketches")
        every = docs.withColumn("row", F.monotonically_increasing_id())
        every = stage.keep(every.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "text"), "documents", compression="zstd")
        # a row for each power of two among the sizes of items
        bound = sketches.groupBy("part").agg(F.max("u").alias("most"), F.min("need").alias("least")).agg(F.max("most").alias("most"), F.min("least").alias("least")).first()
        lists = every.select("doc_id", "text").mapInArrow(listed(bound["least"], bound["most"] + (1 << 63)), ddl)
        hits = lists.join(sketches.select("item", "shingle"), "shingle").select("doc_id", "item").distinct()
        hits = stage.keep(hits, "hits")
        wanted = hits.join(table, "item").select("doc_id", "item", "n", "shingle")
        texts = every.select("doc_id", "text").join(hits.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
        held = texts.mapInArrow(listed(0, (1 << 64) - 1), ddl)
        found = wanted.join(held, ["doc_id", "shingle"]).groupBy("doc_id", "item", "n").agg(F.count("*").alias("n_shared"))
        found = found.where(F.col("n_shared") >= need).withColumnRenamed("n", "n_item")
        found = found.join(every.select("doc_id", "id"), "doc_id").select(F.col("id").alias("doc_id"), "item", "n_item", "n_shared")
    found = stage.keep(found, "found")
    best = F.max_by(F.struct("n_item", "n_shared"), F.struct("n_shared", "n_item")).alias("b")
    pairs = found.join(given.select("item", "item_id"), "item").groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", F.col("b.n_item").alias("n_item"), F.col("b.n_shared").alias("n_shared"))


#: DuckDB SQL of find_leaks with its defaults on `documents` and `benchmark`.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, w, least(len(w), 5) AS k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
bn AS (SELECT item_id, w, count(*) AS n FROM bs GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, w, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k))
SELECT doc_id, item_id, arg_max(n, c * 1000000 + n) AS n_item, max(c) AS n_shared
FROM (SELECT ds.doc_id, ds.w, bs.item_id, bs.w AS bw, bn.n, count(*) AS c FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k JOIN bn ON bn.item_id = bs.item_id AND bn.w = bs.w GROUP BY ALL)
WHERE 5 * c >= 4 * n GROUP BY doc_id, item_id
"""

import random
import zlib

import numpy as np
import pyarrow as pa

from arraylens.llm.quality import STATISTICS, Trees, fit, quality, score, statistics, train


def one_by_one(trees: Trees, x):
    out = []
    for row in x:
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        out.append(total)
    return np.array(out)


def test_flat_trees_match_a_walk_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0.1).astype(float)
    trees = fit(x, y, trees=30)
    fresh = rng.normal(size=(400, 5))
    assert np.allclose(trees.raw(fresh), one_by_one(trees, fresh))
    assert (((trees.probability(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0.1)).mean()) > 0.85


def test_statistics_of_single_texts_equal_those_of_a_batch():
    texts = [None, "", " ", "a", "One two.\nOne two!", "é" * 9, "x " * 4000, "A B C " * 50, None, "12 | 34"]
    whole = statistics(pa.array(texts, pa.string()))
    assert whole.shape == (len(texts), len(STATISTICS)) and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], statistics(pa.array([t], pa.string()))[0])
    assert np.allclose(whole[0], whole[1])


def test_learns_and_never_reads_held_out_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        good = i % 4 > 0
        w = [rng.choice(["stone", "river", "of", "and", "Light", "under"]) for _ in range(60)]
        rows.append((i, " ".join(w) + "." if good else "!! ".join(w).upper()))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(good) if not held else int(not good)))  # wrong where they mustn't be used
    rows += [(600, None), (601, ""), (None, "stone and river"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 as score", "1 as y", "2 as label_id")
    marks = spark.createDataFrame([*labels, (None, 1), (700, 1)], "doc_id long, quality int")
    got = quality(docs, marks).collect()
    assert len(got) == len(rows)
    found = [r for r in got if r.doc_id is not None and r.doc_id < 500 and r.doc_id != 1]
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (600, 601)}) == 1


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality(docs, none).collect()] == [(0.5, 1)]
    assert quality(docs.limit(0), none).collect() == []


def test_held_out_accuracy_on_the_given_table(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = quality(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    bad = [r for r in got if r.quality == 0]
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.8


def test_a_labelled_id_with_many_rows_trains_as_one(spark):
    """The driver gets one row of numbers for a label, whatever the number of its documents."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text", "zzzz"]) for _ in range(30 + i % 40)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    once = train(docs, labels)
    many = docs.unionByName(docs.where("doc_id = 3").join(spark.range(100_000).select(), how="cross").select("doc_id", "text"))
    again = train(many, labels)
    assert np.array_equal(once.threshold, again.threshold) and np.array_equal(once.leaf, again.leaf)
    assert score(docs.where(F.col("doc_id") < 0), once).collect() == []

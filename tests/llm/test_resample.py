import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from arraylens.llm import queries, resample
from arraylens.llm.shingles import utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    made = [grams(t) for _, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, fs in made for f in fs)
    t = Counter(bucket(f) for x in target for f in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for (doc, _), (w, fs) in zip(docs, made):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_features_of_odd_texts():
    texts = ["", None, "...", "A", "ab CD", "Zoë's 12x  y", "字字 字 字", "a" * 5000 + " b " + "ä" * 3000, "x y z w", "\x7f`[@/:{", "end", "start"]
    raw, at = utf8(pa.array(texts, pa.string()))
    text, crc, words = resample.features(raw, at)
    for i, t in enumerate(texts):
        w, fs = grams(t)
        assert words[i] == len(w)
        assert Counter(crc[text == i].tolist()) == Counter(zlib.crc32(f.encode()) for f in fs)


def test_features_of_a_slice():
    column = pa.array(["one two", "three", None, "four five six seven"], pa.string()).slice(1)
    text, crc, words = resample.features(*utf8(column))
    assert words.tolist() == [1, 0, 4]
    assert sorted(crc[text == 2].tolist()) == sorted(zlib.crc32(f.encode()) for f in grams("four five six seven")[1])


def test_odd_rows_against_plain(spark):
    long = "Word" * 60_000
    texts = [None, "", "a b", *(f"w{i} " * 25 for i in range(30)), *["same words here " * 10] * 60, long + " b" * 30]
    docs = [(i if i % 9 else None if i == 9 else 7, t) for i, t in enumerate(texts)]
    target = ["same words", None, "w3 w3 w3", ""]
    given = spark.createDataFrame([(d, t, 1.0, 2, 3) for d, t in docs], "doc_id long, text string, weight double, row long, rank long")
    got = resample.importance(given, spark.createDataFrame([(t,) for t in target], "text string"))
    got = order(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == order(plain(docs, target))
    drawn = resample.resample(given, spark.createDataFrame([(t,) for t in target], "text string"))
    assert drawn.columns == ["doc_id", "text", "weight", "row", "rank"]
    rows = drawn.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and {r.weight for r in rows} == {1.0}
    assert {(r.doc_id, r["rank"]) for r in rows} == {(r[0], r[4]) for r in got if r[4]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resample.importance(none, none.select("text")).collect() == []
    assert [tuple(r) for r in resample.importance(one, none.select("text")).select("doc_id", "n_features", "weight", "score", "rank").collect()] == plain([(1, "a b c " * 10)], [])


def test_gains_are_whole():
    raw, target = np.array([5] * resample.BUCKETS), np.array([1] * resample.BUCKETS)
    assert set(resample.gains(raw, target)) == {math.floor(1000 * math.log(2 * 60000 / (6 * 20000)))}


def test_query_against_plain(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op12_importance_resampling(spark, path).collect()]
    want = plain(docs, target)
    assert order(got) == order(want) and any(r[4] for r in got)

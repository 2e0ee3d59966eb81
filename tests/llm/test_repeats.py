import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from arraylens.llm import queries, repeats

SCHEMA = "doc_id long, text string, kept string, _row long"


def plain(texts, width):
    """(bytes, removed, spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def sample(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeß", k=rng.randint(1, 7))) for _ in range(40)]

    def prose(k):
        return " ".join(rng.choices(words, k=k))

    common, passage = prose(12), prose(25)
    texts = [None, "", "a", "é" * 90, "ab" * 200, "ab" * 170, "x" * 300, common, common]
    for _ in range(n):
        x = prose(rng.randint(0, 40))
        cut = rng.randint(0, len(x))
        texts.append(x[:cut] + rng.choice(["", common, passage, common[5:], passage[:-7], passage + common]) + x[cut:])
    return texts + rng.choices(texts, k=8)


@pytest.mark.parametrize("seed, width, hot", [(1, 20, 2000), (2, 50, 2000), (3, 50, 2), (4, 7, 3)])
def test_against_all_windows(spark, monkeypatch, seed, width, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = sample(seed)
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in enumerate(texts)], SCHEMA)
    got = repeats.cut_repeats(docs, width)
    assert got.columns == ["doc_id", "text", "_row", "kept", "n_bytes", "n_removed", "removed"]
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == texts and {r._row for r in rows} == {7}
    assert [(r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in rows] == plain(texts, width)


def test_one_byte_beyond_and_below_the_width(spark):
    a = "".join(random.Random(9).choices("abcdefgh", k=400))
    docs = spark.createDataFrame([(1, "1" + a), (2, "2" + a[:399]), (3, a[:399] + "3"), (4, a + "4")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.cut_repeats(docs).collect()}
    assert got == {1: 400, 2: 0, 3: 0, 4: 400}


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.cut_repeats(docs).collect() == []
    text = "".join(random.Random(1).choices("abc ", k=900))
    docs = spark.createDataFrame([(1, text)] * 3 + [(None, text)], "doc_id long, text string")
    assert [(r.n_removed, bytes(r.kept)) for r in repeats.cut_repeats(docs).collect()] == [(900, b"")] * 4


def test_many_pieces_of_one_anchor(spark, monkeypatch):
    """A passage shorter than a window in texts that differ around it, and a few that do not."""
    monkeypatch.setattr(repeats, "HOT", 50)
    rng = random.Random(4)
    common = "".join(rng.choices("abcdefgh ", k=370))
    texts = ["".join(rng.choices("ijkl", k=60)) + common + "".join(rng.choices("mnop", k=60)) for _ in range(300)]
    texts += [texts[5][50:] + "q", "r" + texts[7][20:-20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(repeats.cut_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got] == plain(texts, 400)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs], 400)))
    got = queries.op11_suffix_array_dedup(spark, path).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) > 0
    for r in got:
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())

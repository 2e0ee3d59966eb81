import random
import re

import duckdb
import pytest

from arraylens.llm import decontaminate
from arraylens.llm.decontaminate import find_leaks

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items):
    def cut(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))

    def runs(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = {}
    for j, t in items:
        w = cut(t)
        if not w or j is None:
            continue
        k = min(5, len(w))
        own = runs(w, k)
        for i, u in docs:
            both = len(own & runs(cut(u), k))
            if i is not None and both and 5 * both >= 4 * len(own):
                out[i, j] = max(out.get((i, j), (0, 0)), (both, len(own)))
    return sorted((i, j, n, c) for (i, j), (c, n) in out.items())


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 20, 40])))) for j in range(40)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 4, 50, 400]))]
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)[1].upper().split()
            if len(x) > 10 and rng.random() < 0.6:
                x[rng.randrange(len(x))] = "edit"
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, "\n".join(w)))
    docs += [(None, items[0][1]), (90, None), (3, items[5][1]), (3, docs[3][1]), (91, "w1 " * 40000)]
    items += [(50, None), (51, ""), (None, "w1"), (2, items[2][1]), (2, items[3][1])]
    return docs, items


def got(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as shingle", "3 as n")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as words")
    return sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in find_leaks(d, b).collect())


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", limit)
    docs, items = make(7)
    want = brute(docs, items)
    assert got(spark, docs, items) == want and len(want) > 20
    assert got(spark, docs, []) == []
    assert got(spark, [], items) == []


def test_sql(spark):
    docs, items = make(8)
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert sorted(con.execute(decontaminate.ORACLE).fetchall()) == brute(docs, items)

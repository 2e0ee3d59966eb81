import random
import re

import pytest

from arraylens.llm import ngram_join
from arraylens.llm.ngram_join import near_duplicates

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    at = {i: i for i, _ in rows if i is not None}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                at[y] = x
    return sorted(((i, len(a), None if i is None else top(i)) for i, a in sets), key=str)


def got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", "'x' as rep", "1 as n", "2 as token", "3 as component")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((len(rows), edited(rng, base, rng.randrange(0, 5))))
    rows += [(len(rows) + i, None if i else "") for i in range(3)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [
        (5, "A b  C\td e f"), (3, "a B c d e F"), (9, None), (8, ""), (7, " \n\t "), (1, "one two"), (2, "ONE\ntwo"),
        (4, "one two three"), (None, "a b c d e f"), (6, "same id one two three four"), (6, "a b c d e f"),
        (10, "same id one two three four"), (11, "x " * 30000), (12, "x " * 20000), (13, "é É a b c"),
    ]
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, extra=True) == want


def test_empty_table(spark):
    assert got(spark, []) == []


def test_last_join_alone_finds_all(spark, monkeypatch):
    """Without rounds of stars all pairs come from the full join and its filters."""
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    rng = random.Random(3)
    rows = []
    for size in (2, 5, 9, 40, 200):
        base = [rng.choice([f"w{i}" for i in range(60)]) for _ in range(size)]
        rows += [(len(rows) + i, edited(rng, base, i % 4)) for i in range(5)]
    rows += [(rows[0][0], rows[-1][1]), (None, rows[3][1])]
    assert got(spark, rows) == brute(rows)

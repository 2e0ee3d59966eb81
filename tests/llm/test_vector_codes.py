import hashlib
import math
import random

import numpy as np
import pytest

from arraylens.llm import queries, vector_codes


def plain(rows, parts=4, entries=256, rounds=4):
    """{vec_id: (code, error)} and the codebooks, by comparing with every entry."""
    kept = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v))
    kept = [(i, v) for i, v in kept if len(v) == len(kept[0][1])]
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for _, v in kept] for p in range(parts)]
    books = [[x[:] for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for c, book in zip(cut, books):
            groups = {}
            for x in c:
                groups.setdefault(nearest(x, book)[1], []).append(x)
            for j, xs in groups.items():
                book[j] = [sum(col) // len(xs) for col in zip(*xs)]
    out = {}
    for n, (i, _) in enumerate(kept):
        found = [nearest(c[n], book) for c, book in zip(cut, books)]
        out[i] = ("".join(f"{j:02x}" for _, j in found), sum(e for e, _ in found))
    return out, books


def test_exponion_finds_the_first_nearest_entry():
    rng = np.random.default_rng(2)
    for scale in (3, 2000, 1 << 27, 1 << 39):
        book = rng.integers(-scale, scale, (40, 5))
        book[7] = book[3]
        x = np.concatenate([rng.integers(-scale, scale, (200, 5)), book])
        former = rng.integers(0, 40, len(x))
        entry, apart = vector_codes.exponion(x, book, former)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), j) for j, e in enumerate(book)) for r in x]
        assert [(int(d), int(e)) for d, e in zip(apart, entry)] == want


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_small_table_against_plain(spark, kind):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [round(x + rng.gauss(0, 0.1), 3) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(900 + i, [0.5] * 8, 1) for i in range(40)]
    odd = [(1000, None, 1), (1001, [None] * 8, 1), (1002, [0.1] * 7 + [float("nan")], 2), (1003, [float("inf")] + [0.0] * 7, 2), (1004, [], 1), (1005, [0.1] * 6, 1)]
    given = spark.createDataFrame([(*r, "mine", 1) for r in rows + odd], f"vec_id long, embedding {kind}, label int, code string, part int")
    want, books = plain([(i, None if v is None else list(np.array(v, np.float32 if "float" in kind else float).astype(float))) for i, v, _ in rows], entries=20)
    codes, made = vector_codes.compress(given, entries=20)
    got = vector_codes.code_digests(codes, made).collect()
    assert [b.tolist() for b in made] == books
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == len(want)
    label = {i: x for i, _, x in rows}
    total = {x: sum(e for i, (_, e) in want.items() if label[i] == x) for x in (None, 1, 2)}
    assert all(r.label_error == total[label[r.vec_id]] for r in got)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_repeated_null_and_too_few_ids(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], "a"), (5, [1.0, 2.0, 3.0, 4.0], "a"), (None, [0.0] * 4, None), (1, [1e8, -1e8, 0.0, 5e-324], "b")]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    got = vector_codes.code_digests(codes, books).collect()
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got) == [(0, "03030000", 0), (1, "00000000", 0), (5, "01010101", 0), (5, "01010101", 0)]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 3), (2, [float("nan")], 3)]):
        codes, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        assert vector_codes.code_digests(codes, books).collect() == [] and books == []


def test_query(spark):
    path = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    want, books = plain([(r.vec_id, list(r.embedding)) for r in given])
    got = queries.op13_vector_codes(spark, path).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == len(want)

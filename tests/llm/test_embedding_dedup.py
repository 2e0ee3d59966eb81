import math

import numpy as np

from arraylens.llm import embedding_dedup
from arraylens.llm.embedding_dedup import box_of, compare, embedding_duplicates, tile_pairs


def brute(rows, least):
    n = len(rows)
    at, links = list(range(n)), [0] * n

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    def vector(r):
        if r[0] is None or r[2] is None or not r[1] or None in r[1]:
            return None
        x = np.array(r[1], float)
        return x if np.isfinite(x).all() and x.any() else None

    vs = [vector(r) for r in rows]
    order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for p, i in enumerate(order):
        for j in order[:p]:
            x, y = vs[i], vs[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y):
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                    at[b] = a
    return sorted(((r[0], links[i], rows[top(i)][0] if vs[i] is not None else r[0]) for i, r in enumerate(rows)), key=str)


def make():
    rng = np.random.default_rng(2)
    rows = []
    for g in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])
            rows.append((len(rows), [float(x) for x in v * rng.choice([1, 1, 3])], int(rng.choice([1, 1, 2]))))
    v = rows[0][1]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [*v[:15], None], 1), (904, [*v[:15], float("nan")], 1)]
    rows += [(905, [*v[:15], float("inf")], 1), (906, v, None), (907, v[:8], 1), (908, v[:8], 1), (None, v, 1), (909, v, 1), (910, v, 1)]
    return [rows[i] for i in rng.permutation(len(rows))]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as rep", "3 as dim")
    got = embedding_duplicates(df, 0.93).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_duplicates(df.limit(0)).collect() == []


def test_pruned_products_lose_no_pair():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 32)) * np.linspace(2, 0.1, 32)
    b = np.concatenate([a[:50] + rng.normal(size=(50, 32)) * 0.05, rng.normal(size=(200, 32))])
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    for least in (0.5, 0.9, 0.99):
        want = set(zip(*np.nonzero(a @ b.T >= least), strict=True))
        assert set(zip(*compare(a, b, least)[:2], strict=True)) == want


def test_boxes_lose_no_pair_and_tiles_far_apart_do_not_meet(spark):
    rng = np.random.default_rng(7)
    rows, at = [], 0
    for t in range(40):
        centre = rng.normal(size=20) * (0.9 ** np.arange(20))
        x = centre + 0.15 * rng.normal(size=(30, 20))
        x /= np.linalg.norm(x, axis=1)[:, None]
        lo, hi = box_of(x)
        rows.append((t, "a" if t % 4 else "b", 20, lo.tolist(), hi.tolist(), x))
    ddl = "tile long, label string, dim int, lo array<double>, hi array<double>"
    got = {tuple(r) for r in tile_pairs(spark.createDataFrame([r[:5] for r in rows], ddl), 0.93).collect()}
    need = {(p[0], q[0]) for p in rows for q in rows if p[0] <= q[0] and p[1] == q[1] and (p[5] @ q[5].T).max() >= 0.93}
    every = sum(p[1] == q[1] and p[0] <= q[0] for p in rows for q in rows)
    assert need <= got and len(got) < every


def test_products_at_the_threshold_are_decided_on_the_vectors(spark):
    c = 0.93
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [c, math.sqrt(1 - c * c)]), (3, "a", [c - 1e-10, math.sqrt(1 - (c - 1e-10) ** 2) * -1])]
    got = {r.vec_id: r.n_links for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    want = {i: sum(j != i and float(np.dot(u, v)) / np.linalg.norm(u) / np.linalg.norm(v) >= c for j, _, v in rows) for i, _, u in rows}
    assert got == want and got[3] == 0


def test_vectors_of_one_code_are_parted(spark, monkeypatch):
    """Many different vectors near one another: range partitions part them by id, and the links are whole."""
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    rng = np.random.default_rng(7)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in base + rng.normal(size=8) * 1e-4], 1) for i in range(1500)]
    got = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 1500 and {(r.n_links, r.component_id) for r in got} == {(1499, 0)}

import time

import numpy as np

from arraylens.llm.decontaminate import candidates, partitions


def sketches(rng, items, size):
    n = rng.integers(size[0], size[1], items)
    sets = [np.sort(rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)) for k in n]
    needs = -(-4 * n // 5)
    kept = [x[: k - m + 1] for x, k, m in zip(sets, n, needs, strict=True)]
    owner = np.repeat(np.arange(items), [len(x) for x in kept])
    return sets, partitions(np.concatenate(kept), owner, n, needs), n, needs


def test_candidates_hold_every_contained_item():
    rng = np.random.default_rng(1)
    sets, tables, n, needs = sketches(rng, 200, (1, 90))
    assert len(tables) == len(set(np.frexp(n)[1]))
    for _ in range(50):
        picked = rng.choice(200, 3, replace=False)
        parts = [rng.choice(sets[i], needs[i], replace=False) for i in picked]
        doc = np.unique(np.concatenate([*parts, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
        found = candidates(doc, tables)
        assert set(picked) <= set(found)
        brute = {i for i, x in enumerate(sets) if np.isin(x[: n[i] - needs[i] + 1], doc).any() and len(doc) >= needs[i]}
        assert set(found) == brute
    assert not len(candidates(np.zeros(0, np.uint64), tables))


def test_cost_of_a_document_does_not_follow_the_items():
    rng = np.random.default_rng(2)
    docs = [np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64)) for _ in range(400)]
    took = []
    for items in (1000, 10000):
        tables = sketches(rng, items, (20, 60))[1]
        times = []
        for _ in range(3):
            began = time.process_time()
            for d in docs:
                candidates(d, tables)
            times.append(time.process_time() - began)
        took.append(min(times))
    assert took[1] < 3 * took[0]

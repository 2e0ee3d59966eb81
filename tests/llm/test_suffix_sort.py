import numpy as np
import pytest

from arraylens.llm import suffix_sort


def plain(text, depth):
    def shared(a, b):
        k = 0
        while k < depth and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        return k

    sa = sorted(range(len(text)), key=lambda i: text[i : i + depth])
    return sa, [0, *(shared(a, b) for a, b in zip(sa, sa[1:]))]


@pytest.mark.parametrize("wide", [1, 4096])
@pytest.mark.parametrize("memory, short", [(1000, 1), (1000, 1000), (8, 4)])
def test_arrays_of_random_and_periodic_texts(tmp_path, monkeypatch, wide, memory, short):
    rng = np.random.default_rng(wide + memory + short)
    monkeypatch.setattr(suffix_sort, "WIDE", wide)
    for _ in range(60):
        monkeypatch.setattr(suffix_sort, "BATCH", int(rng.choice([1, 3, 1000])))
        n, sigma, depth = int(rng.integers(1, 80)), int(rng.choice([2, 3, 6, 60])), int(rng.choice([2, 5, 9, 400]))
        x = rng.integers(1, sigma + 1, n)
        if rng.random() < 0.4:
            x = np.resize(x[: max(1, n // 5)], n)
        text = np.append(x, 0).astype(np.uint16)
        sa, common = suffix_sort.suffix_array(text, sigma + 1, depth, str(tmp_path), memory, short)
        want, shared = plain(text.tolist(), depth)
        assert sorted(sa.tolist()) == list(range(n + 1))
        assert [text[i : i + depth].tolist() for i in sa] == [text[i : i + depth].tolist() for i in want]
        assert common.tolist() == shared


def test_range_minima():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 500, 1000).astype(np.uint16)
    least = suffix_sort.RangeMin(v)
    a, b = np.sort(rng.integers(0, 1000, (2, 500)), 0)
    assert least.least(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b)]


def test_queue_is_first_in_first_out_under_a_key(tmp_path):
    queue = suffix_sort.Queue(suffix_sort.Scratch(str(tmp_path), 4), (np.uint16, np.int32, np.uint16))
    held, rng, out = [], np.random.default_rng(5), []
    for i in range(40):
        key = rng.integers(0, 9, int(rng.integers(1, 9))).astype(np.uint16)
        place = np.arange(len(key), dtype=np.int32) + 100 * i
        queue.push(key, place, np.zeros(len(key), np.uint16))
        held += list(zip(key.tolist(), place.tolist()))
    for below in range(1, 10):
        while len((got := queue.pop(below, 7))[0]):
            out += list(zip(got[0].tolist(), got[1].tolist()))
    assert out == sorted(held)

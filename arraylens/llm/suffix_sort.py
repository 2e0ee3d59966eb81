"""Suffix and common-prefix arrays by external induced sorting, up to a depth.

Suffixes are S-type (smaller than the next one) or L-type; an S* suffix is the
first of a run of S-types. Two scans put all suffixes in order from the ordered
S* ones: in ascending order each suffix places the L-type one before it, in
descending order each places the S-type one before it. What is placed waits in
a priority queue as a tuple (character, common prefix with the tuple before it
under that character, position). Tuples come out by character and first in,
first out within one, and the queue keeps its longer runs on disk.

A first pair of scans, over S* suffixes in any order, sorts the strings from one
S* position to the next, which become the names of a shorter text; that text is
sorted by recursion, or in memory once it is short. Common prefixes are counted
to `depth` at most: suffixes that agree so far may come in any order.

A batch of suffixes is scanned at once. Its characters are a range in which no
suffix places another one, or one single character whose tuples are taken as
they come. Arrays longer than `memory` are mapped from files in `folder`.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Items of an array that is still held in memory.
MEMORY = 1 << 22
#: Suffixes scanned at once.
BATCH = 1 << 16
#: Characters from which on ranges of several are scanned together.
WIDE = 1 << 12
_BLOCK = 16


class Scratch:
    """Arrays in memory, or in files of one folder where they are long."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory = folder, memory

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n <= self.memory:
            return np.empty(n, dtype)
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)  # the mapping holds the file; it goes with the array
        return out


class RangeMin:
    """Minima of ranges of an array, by minima of blocks and of runs of blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // _BLOCK)
        self.values = np.full(n * _BLOCK, np.iinfo(np.uint16).max, np.uint16)
        self.values[: len(values)] = values
        blocks = self.values.reshape(n, _BLOCK)
        self.front = np.minimum.accumulate(blocks, 1).ravel()
        self.back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.runs = [blocks.min(1)] if n else []
        while 2 << (len(self.runs) - 1) <= n:
            x, half = self.runs[-1], 1 << (len(self.runs) - 1)
            self.runs.append(np.minimum(x[:-half], x[half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of values[lo..hi], both ends included."""
        a, b = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.back[lo], self.front[hi])
        near = np.flatnonzero(a == b)
        if len(near):
            x, span = lo[near], hi[near] - lo[near]
            found = self.values[x]
            for k in range(1, int(span.max()) + 1):
                np.minimum(found, np.where(k <= span, self.values[np.minimum(x + k, hi[near])], found), out=found)
            out[near] = found
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, last = a[far] + 1, b[far] - 1
            level = np.frexp((last - first + 1).astype(float))[1] - 1
            for r in np.flatnonzero(np.bincount(level)):
                at = np.flatnonzero(level == r)
                x = self.runs[r]
                both = np.minimum(x[first[at]], x[last[at] - (1 << int(r)) + 1])
                out[far[at]] = np.minimum(out[far[at]], both)
        return out


class Queue:
    """Tuples (key, position, common prefix), ordered by key and first in, first out within one."""

    def __init__(self, scratch: Scratch, kinds: tuple):
        self.scratch, self.kinds = scratch, kinds
        self.runs: list[list] = []  # oldest first: arrays of tuples sorted by key, and how many are out

    def push(self, *tuples: np.ndarray) -> None:
        if not len(tuples[0]):
            return
        order = np.argsort(tuples[0], kind="stable")
        self.runs.append([[x[order] for x in tuples], 0])
        while len(self.runs) > 1 and self._left(-2) < 2 * self._left(-1):
            new, old = self.runs.pop(), self.runs.pop()
            parts = [(run[0][0][run[1] :], run) for run in (old, new)]
            order = np.argsort(np.concatenate([p for p, _ in parts]), kind="stable")
            merged = []
            for i, kind in enumerate(self.kinds):
                x = self.scratch.array(len(order), kind)
                x[:] = np.concatenate([run[0][i][run[1] :] for run in (old, new)])[order]
                merged.append(x)
            self.runs.append([merged, 0])

    def _left(self, i: int) -> int:
        return len(self.runs[i][0][0]) - self.runs[i][1]

    def pop(self, below: int, most: int | None = None) -> list[np.ndarray]:
        """Tuples with keys under `below`; with `most`, so many of one key, the oldest."""
        out = []
        for run in self.runs:
            tuples, at = run
            end = at + int(np.searchsorted(tuples[0][at:], below, "left"))
            if most is not None:
                end = min(end, at + most - sum(len(x[0]) for x in out))
            if end > at:
                out.append([x[at:end] for x in tuples])
                run[1] = end
            if most is not None and sum(len(x[0]) for x in out) >= most:
                break
        self.runs = [run for run in self.runs if run[1] < len(run[0][0])]
        if not out:
            return [np.empty(0, k) for k in self.kinds]
        joined = [np.concatenate(x) for x in zip(*out, strict=True)]
        if most is None and len(out) > 1:
            order = np.argsort(joined[0], kind="stable")
            joined = [x[order] for x in joined]
        return joined


class Prefixes:
    """Common prefixes of what a scan places under each key with what it placed there before."""

    def __init__(self, keys: int, depth: int):
        self.depth = depth
        self.tail = np.zeros(keys, np.uint16)  # least prefix behind the last placing, within its batch
        self.batch = np.full(keys, -1, np.int64)
        self.now = 0
        self.since = np.zeros(0, np.int64), np.zeros(0, np.uint16)  # batches with ascending minima from each up to now

    def place(self, scanned: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """scanned: prefixes of a batch's suffixes with those before them; at: those that place one under keys."""
        out = np.zeros(len(at), np.uint16)
        if len(at):
            order = np.argsort(keys, kind="stable")
            k, j = keys[order], at[order]
            again = k[1:] == k[:-1]
            first, last = np.append(True, ~again), np.append(~again, True)
            found = np.zeros(len(at), np.uint16)
            found[1:][again] = RangeMin(scanned).least(j[:-1][again] + 1, j[1:][again]) + 1
            c = k[first]
            upto = np.minimum.accumulate(scanned)[j[first]]
            i = np.searchsorted(self.since[0], self.batch[c] + 1)
            between = np.append(self.since[1], np.uint16(self.depth))[i]
            low = np.minimum(np.minimum(upto, between), self.tail[c])
            found[first] = np.where(self.batch[c] < 0, 0, low + 1)
            behind = np.append(np.minimum.accumulate(scanned[::-1])[::-1][1:], np.uint16(self.depth))
            self.tail[k[last]] = behind[j[last]]
            self.batch[k[last]] = self.now
            out[order] = np.minimum(found, self.depth)
        least = scanned.min()
        keep = self.since[1] < least
        self.since = np.append(self.since[0][keep], self.now), np.append(self.since[1][keep], least).astype(np.uint16)
        self.now += 1
        return out


def _chunks(n: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    return ((i, min(n, i + size)) for i in range(0, n, size))


def s_types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is S-type; text ends with its only, smallest character."""
    n = len(text)
    out = scratch.array(n, np.bool_)
    out[n - 1] = follows = True
    for lo, hi in reversed(list(_chunks(n - 1))):
        a, b = text[lo:hi], text[lo + 1 : hi + 1]
        sure = np.flatnonzero(a != b)
        nearest = np.searchsorted(sure, np.arange(hi - lo))
        rise = np.append(a[sure] < b[sure], follows)
        out[lo:hi] = rise[nearest]
        follows = bool(out[lo])
    return out


def run_length(text: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How often the character at each place comes there in a row, `most` at most."""
    out = np.ones(len(at), np.int64)
    todo = np.arange(len(at))
    for k in range(1, most):
        todo = todo[at[todo] + k < len(text)]
        todo = todo[text[at[todo] + k] == text[at[todo]]]
        if not len(todo):
            break
        out[todo] = k + 1
    return out


def spans(nearest: np.ndarray, sizes: np.ndarray, wide: bool) -> list[tuple[int, int]]:
    """Ranges of keys in which no suffix places another; a key that places under itself, or a large one, is alone."""
    n = len(sizes)
    if not wide:
        return [(c, c + 1) for c in np.flatnonzero(sizes).tolist()]
    out, lo, near, total = [], 0, n, 0
    for c, (to, size) in enumerate(zip(nearest.tolist(), sizes.tolist(), strict=True)):
        alone = to == c or size > BATCH
        if c > lo and (alone or near <= c or total + size > BATCH):
            out.append((lo, c))
            lo, near, total = c, n, 0
        near, total = min(near, to), total + size
        if alone:
            out.append((c, c + 1))
            lo, near, total = c + 1, n, 0
    return out + [(lo, n)] * (lo < n)


class _Level:
    """One text of the recursion: its types, characters and S* positions."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int, scratch: Scratch):
        self.text, self.sigma, self.depth, self.scratch = text, sigma, depth, scratch
        self.n = n = len(text)
        self.place = np.int32 if n < 2**31 else np.int64
        s = s_types(text, scratch)
        self.sizes_l, self.sizes_s = np.zeros(sigma, np.int64), np.zeros(sigma, np.int64)
        up, down = np.full(sigma, sigma, np.int64), np.full(sigma, -1, np.int64)
        starts = []
        self.wide = sigma > WIDE
        for lo, hi in _chunks(n):
            t, kind = np.asarray(text[lo:hi]), s[lo:hi]
            self.sizes_s += np.bincount(t[kind], minlength=sigma)
            self.sizes_l += np.bincount(t[~kind], minlength=sigma)
            before = np.asarray(text[max(lo - 1, 0) : hi - 1]) if lo else np.append(t[:1], t[:-1])
            was_s = np.asarray(s[lo - 1 : hi - 1]) if lo else np.append(True, kind[:-1])
            star = kind & ~was_s
            starts.append((lo + np.flatnonzero(star)).astype(self.place))
            if self.wide:
                inside = np.arange(lo, hi) > 0
                x = inside & ~was_s
                np.minimum.at(up, t[x], before[x].astype(np.int64))
                x = inside & was_s
                np.maximum.at(down, t[x], before[x].astype(np.int64))
        self.stars = scratch.array(sum(map(len, starts)), self.place)
        self.stars[:] = np.concatenate(starts)
        self.up, self.down = up, sigma - 1 - down[::-1]
        self.first = np.append(0, np.cumsum(self.sizes_l + self.sizes_s))
        self.kinds = (np.uint16 if sigma < 2**16 else np.uint32, self.place, np.uint16)

    def scan(self, queue: Queue, prefixes: Prefixes, pos: np.ndarray, scanned: np.ndarray, chars: np.ndarray, fall: bool, equal: np.ndarray | bool) -> np.ndarray:
        """Places the suffixes before those at pos; fall: in the descending scan. Returns the characters before (sigma at the start)."""
        before = np.where(pos > 0, self.text[np.maximum(pos, 1) - 1].astype(np.int64), self.sigma if fall else -1)
        c = chars.astype(np.int64)
        goes = (before < c) | (equal & (before == c)) if fall else (before > c) | (equal & (before == c))
        at = np.flatnonzero(goes)
        key = self.sigma - 1 - before[at] if fall else before[at]
        prefix = prefixes.place(scanned, at, key)
        queue.push(key.astype(self.kinds[0]), (pos[at] - 1).astype(self.place), prefix)
        return before

    def ascend(self, seeds: np.ndarray, seed_prefix: np.ndarray, naming: bool) -> tuple[np.ndarray, np.ndarray]:
        """L-type suffixes in order with their prefixes, from the S* ones in order (of first characters alone if naming)."""
        n = int(self.sizes_l.sum())
        out, out_prefix = self.scratch.array(n, self.place), self.scratch.array(n, np.uint16)
        count = np.zeros(self.sigma, np.int64)
        for lo, hi in _chunks(len(seeds)):
            count += np.bincount(self.text[seeds[lo:hi]], minlength=self.sigma)
        offset = np.append(0, np.cumsum(count))
        queue, prefixes = Queue(self.scratch, self.kinds), Prefixes(self.sigma, self.depth)
        done = 0

        def joint(last: np.ndarray, star: np.ndarray) -> np.ndarray:
            if naming:
                return np.ones(len(last), np.uint16)
            return np.minimum(run_length(self.text, last, self.depth), run_length(self.text, star, self.depth)).astype(np.uint16)

        def keep(pos: np.ndarray, prefix: np.ndarray) -> None:
            nonlocal done
            out[done : done + len(pos)] = pos
            out_prefix[done : done + len(pos)] = prefix
            done += len(pos)

        for lo, hi in spans(self.up, self.sizes_l + count, self.wide):
            if hi - lo == 1:
                last = None
                while True:
                    chars, pos, prefix = queue.pop(hi, BATCH)
                    if not len(pos):
                        break
                    keep(pos, prefix)
                    self.scan(queue, prefixes, pos, prefix, chars, False, True)
                    last = pos[-1:]
                for a in range(offset[lo], offset[hi], BATCH):
                    b = min(a + BATCH, offset[hi])
                    pos, prefix = np.asarray(seeds[a:b]), np.array(seed_prefix[a:b])
                    if a == offset[lo]:
                        prefix[0] = 0 if last is None else joint(last, pos[:1])[0]
                    self.scan(queue, prefixes, pos, prefix, np.full(b - a, lo), False, False)
                continue
            chars, pos, prefix = queue.pop(hi)
            keep(pos, prefix)
            star, star_prefix = np.asarray(seeds[offset[lo] : offset[hi]]), np.array(seed_prefix[offset[lo] : offset[hi]])
            star_chars = np.repeat(np.arange(lo, hi), count[lo:hi])
            head = np.flatnonzero(np.append(True, star_chars[1:] != star_chars[:-1])) if len(star) else np.zeros(0, np.int64)
            end = np.searchsorted(chars, star_chars[head], "right")
            mine = (end > 0) & (chars[np.maximum(end, 1) - 1] == star_chars[head]) if len(chars) else np.zeros(len(head), bool)
            star_prefix[head] = 0
            star_prefix[head[mine]] = joint(pos[end[mine] - 1], star[head[mine]])
            if not len(pos) + len(star):
                continue
            key = np.concatenate([2 * chars.astype(np.int64), 2 * star_chars + 1])
            order = np.argsort(key, kind="stable")
            both = [np.concatenate(x)[order] for x in ((pos, star), (prefix, star_prefix))]
            self.scan(queue, prefixes, *both, key[order] >> 1, False, (key[order] & 1) == 0)
        return out, out_prefix

    def descend(self, l_pos: np.ndarray, l_prefix: np.ndarray, naming: bool) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order with their prefixes; if naming, the S* ones alone."""
        sigma, top = self.sigma, self.sigma - 1
        offset = np.append(0, np.cumsum(self.sizes_l))
        n = len(self.stars) if naming else self.n
        out, out_prefix = self.scratch.array(n, self.place), self.scratch.array(n, np.uint16)
        queue, prefixes = Queue(self.scratch, self.kinds), Prefixes(sigma + 1, self.depth)
        named = Prefixes(1, self.depth + 1)  # one is taken off
        done = n  # of S* suffixes, from the end

        def write(pos: np.ndarray, scanned: np.ndarray, chars: np.ndarray, kind_s: np.ndarray, before: np.ndarray, rank: np.ndarray) -> None:
            nonlocal done
            if naming:
                at = np.flatnonzero(kind_s & (before > chars) & (pos > 0))
                prefix = named.place(scanned, at, np.zeros(len(at), np.int64))
                out[done - len(at) : done] = pos[at][::-1]
                # the prefix is shared with the larger one, which stands behind
                above = np.maximum(prefix, 1) - 1
                ends = np.arange(done - 1, done - 1 - len(at), -1) + 1
                inside = ends < n
                out_prefix[ends[inside]] = above[inside]
                done -= len(at)
                return
            out[rank] = pos
            inside = rank + 1 < self.first[chars + 1]
            out_prefix[rank[inside] + 1] = scanned[inside]
            out_prefix[self.first[chars[~inside]]] = 0

        def joint(star: np.ndarray, last: np.ndarray) -> np.ndarray:
            return np.minimum(run_length(self.text, star, self.depth), run_length(self.text, last, self.depth)).astype(np.uint16)

        def larger(idx: np.ndarray, chars: np.ndarray) -> np.ndarray:
            """Prefixes of the L-type suffixes idx with the next larger L-type one; 0 for the largest of a character."""
            inner = idx + 1 < offset[chars + 1]
            return np.where(inner, l_prefix[np.minimum(idx + 1, max(len(l_prefix) - 1, 0))], 0).astype(np.uint16)

        for lo, hi in spans(self.down, (self.sizes_l + self.sizes_s)[::-1], self.wide):
            if hi - lo == 1:
                c, last, seen = top - lo, None, 0
                if c == 0:  # the end of the text alone: it is no L-type's place and places nothing here
                    end = np.array([self.n - 1])
                    zero, one = np.zeros(1, np.int64), np.ones(1, bool)
                    before = np.array([int(self.text[self.n - 2])]) if self.n > 1 else np.array([sigma])
                    write(end, np.zeros(1, np.uint16), zero, one, before, zero)
                    continue
                while True:
                    _, pos, prefix = queue.pop(hi, BATCH)
                    if not len(pos):
                        break
                    chars = np.full(len(pos), c)
                    before = self.scan(queue, prefixes, pos, prefix, chars, True, True)
                    rank = self.first[c + 1] - 1 - seen - np.arange(len(pos))
                    write(pos, prefix, chars, np.ones(len(pos), bool), before, rank)
                    seen += len(pos)
                    last = pos[-1:]
                for b in range(offset[c + 1], offset[c], -BATCH):
                    a = max(b - BATCH, offset[c])
                    idx = np.arange(b - 1, a - 1, -1)
                    pos, chars = np.asarray(l_pos[a:b])[::-1], np.full(b - a, c)
                    scanned = larger(idx, chars)
                    if b == offset[c + 1] and last is not None:
                        scanned[0] = joint(last, pos[:1])[0]
                    before = self.scan(queue, prefixes, pos, scanned, chars, True, False)
                    write(pos, scanned, chars, np.zeros(b - a, bool), before, self.first[c] + idx - offset[c])
                continue
            keys, pos, prefix = queue.pop(hi)
            a, b = offset[sigma - hi], offset[sigma - lo]
            idx = np.arange(b - 1, a - 1, -1)
            low, low_chars = np.asarray(l_pos[a:b])[::-1], np.repeat(np.arange(sigma - hi, sigma - lo), self.sizes_l[sigma - hi : sigma - lo])[::-1]
            low_prefix = larger(idx, low_chars)
            chars = top - keys.astype(np.int64)
            head = np.flatnonzero(np.append(True, low_chars[1:] != low_chars[:-1])) if len(low) else np.zeros(0, np.int64)
            end = np.searchsorted(keys, top - low_chars[head], "right")
            mine = (end > 0) & (keys[np.maximum(end, 1) - 1] == top - low_chars[head]) if len(keys) else np.zeros(len(head), bool)
            low_prefix[head[mine]] = joint(pos[end[mine] - 1], low[head[mine]])
            ends = hi == sigma  # the end of the text is the last suffix
            if ends:
                pos, prefix, chars = np.append(pos, self.n - 1), np.append(prefix, np.uint16(0)), np.append(chars, 0)
            if not len(pos) + len(low):
                continue
            fresh = np.append(True, chars[1:] != chars[:-1]) if len(chars) else np.zeros(0, bool)
            seen = np.arange(len(chars)) - np.maximum.accumulate(np.where(fresh, np.arange(len(chars)), 0)) if len(chars) else np.zeros(0, np.int64)
            rank = np.concatenate([self.first[chars + 1] - 1 - seen, self.first[low_chars] + idx - offset[low_chars]])
            key = np.concatenate([2 * (top - chars), 2 * (top - low_chars) + 1])
            order = np.argsort(key, kind="stable")
            pos, scanned, rank, chars = (np.concatenate(x)[order] for x in ((pos, low), (prefix, low_prefix), (rank,), (chars, low_chars)))
            kind_s = (key[order] & 1) == 0
            before = self.scan(queue, prefixes, pos, scanned, chars, True, kind_s)
            write(pos, scanned, chars, kind_s, before, rank)
        return out, out_prefix

    def names(self) -> tuple[np.ndarray, int, np.ndarray]:
        """The shorter text, its number of names, and the prefixes of neighbouring names."""
        text, stars, m = self.text, self.stars, len(self.stars)
        seeds, at = self.scratch.array(m, self.place), 0
        order = np.argsort(np.concatenate([text[stars[lo:hi]] for lo, hi in _chunks(m)]), kind="stable")
        for lo, hi in _chunks(m):
            seeds[lo:hi] = stars[order[lo:hi]]
        del order
        prefix = self.scratch.array(m, np.uint16)
        prefix[:] = 1
        pos, prefix = self.descend(*self.ascend(seeds, prefix, True), True)
        new, reduced = self.scratch.array(m, np.bool_), self.scratch.array(m, np.uint32)
        where = self.scratch.array(m, self.place)
        for lo, hi in _chunks(m):
            where[lo:hi] = np.searchsorted(stars, pos[lo:hi])
        name, shared = -1, []
        sizes = self.scratch.array(m, np.int64)
        for lo, hi in _chunks(m):
            i = np.asarray(where[lo:hi])
            sizes[lo:hi] = np.where(i + 1 < m, stars[np.minimum(i + 1, m - 1)].astype(np.int64) - stars[i] + 1, 1)
        for lo, hi in _chunks(m):
            size, p = np.asarray(sizes[lo:hi]), np.asarray(prefix[lo:hi]).astype(np.int64)
            above = np.append(sizes[lo - 1] if lo else -1, size[:-1])
            new[lo:hi] = ~((p >= self.depth) | ((p >= size) & (size == above)))
            if lo == 0:
                new[0] = True
            ids = name + np.cumsum(new[lo:hi])
            reduced[where[lo:hi]] = ids
            name = int(ids[-1])
            shared.append(prefix[lo:hi][new[lo:hi]])
        return reduced, name + 1, np.concatenate(shared)

    def ordered(self, reduced: np.ndarray, shared: np.ndarray, sa: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The S* suffixes in order and their prefixes in characters, from the order of the shorter text."""
        stars, m = self.stars, len(self.stars)
        pos, prefix = self.scratch.array(m, self.place), self.scratch.array(m, np.uint16)
        least = RangeMin(shared)
        for lo, hi in _chunks(m):
            i = np.asarray(sa[lo:hi]).astype(np.int64)
            pos[lo:hi] = stars[i]
            out = np.zeros(hi - lo, np.int64)
            h = np.append(sa[lo - 1] if lo else i[0], i[:-1]).astype(np.int64)
            k = np.asarray(common[lo:hi]).astype(np.int64)
            deep = k >= depth
            out[deep] = self.depth
            at = np.flatnonzero(~deep & (np.arange(lo, hi) > 0))
            a, b = h[at] + k[at], i[at] + k[at]
            far = stars[b].astype(np.int64) - stars[i[at]]
            x, y = reduced[a].astype(np.int64), reduced[b].astype(np.int64)
            same = least.least(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)
            size_a, size_b = (np.where(z + 1 < m, stars[np.minimum(z + 1, m - 1)].astype(np.int64) - stars[z] + 1, 1) for z in (a, b))
            size = np.minimum(size_a, size_b)
            over = np.flatnonzero((same >= size) & (same < self.depth))
            # one string begins with the other: both go on with runs of its last character
            ends = [stars[z[over]].astype(np.int64) + size[over] - 1 for z in (a, b)]
            runs = np.minimum(*(run_length(self.text, e, self.depth) for e in ends))
            same[over] = size[over] - 1 + runs
            out[at] = far + same
            prefix[lo:hi] = np.minimum(out, self.depth)
        return pos, prefix


def _doubled(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix and prefix array of a text that fits in memory, by prefix doubling."""
    n = len(text)
    ranks = [text.astype(np.int64)]
    top = int(ranks[0].max())
    while 1 << (len(ranks) - 1) < depth and top + 1 < n:
        half, r = 1 << (len(ranks) - 1), ranks[-1]
        key = r * (top + 2)
        key[: n - half] += r[half:] + 1
        order = np.argsort(key)
        key = key[order]
        place = np.append(0, np.cumsum(key[1:] != key[:-1]))
        r = np.empty(n, np.int64)
        r[order] = place
        ranks.append(r)
        top = int(place[-1])
    sa = np.argsort(ranks[-1])
    a, b = sa[:-1].copy(), sa[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for r in reversed(range(len(ranks))):
        inside = (a < n) & (b < n)
        equal = inside & (ranks[r][np.minimum(a, n - 1)] == ranks[r][np.minimum(b, n - 1)])
        step = np.where(equal, 1 << r, 0)
        a, b, common = a + step, b + step, common + step
    return sa, np.append(0, np.minimum(common, depth)).astype(np.uint16)


def suffix_array(text: np.ndarray, sigma: int, depth: int, folder: str, memory: int = MEMORY, short: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it, `depth` at most).

    text holds the characters 0 to sigma - 1 and ends with a 0, its only one.
    Suffixes that agree in `depth` characters come in any order. Shorter texts of
    the recursion are sorted in memory from `short` characters down.
    """
    scratch = Scratch(folder, memory)
    if len(text) < 3:
        return _doubled(np.asarray(text), depth)
    level = _Level(text, sigma, depth, scratch)
    reduced, names, shared = level.names()
    m, inner = len(reduced), depth // 2 + 1
    if names == m:
        sa, common = scratch.array(m, np.int64), np.zeros(1, np.uint16)
        for lo, hi in _chunks(m):
            sa[reduced[lo:hi]] = np.arange(lo, hi)
        common = np.broadcast_to(common, (m,))
    elif m <= (memory if short is None else short):
        sa, common = _doubled(np.asarray(reduced), inner)
    else:
        sa, common = suffix_array(reduced, names, inner, folder, memory, short)
    seeds, prefix = level.ordered(reduced, shared, sa, common, inner)
    del reduced, sa, common
    return level.descend(*level.ascend(seeds, prefix, False), False)

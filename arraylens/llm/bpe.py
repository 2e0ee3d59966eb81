"""BPE encoding and decoding (operator 8): speculate and verify.

Each distinct word is first cut by greedy longest match. A cut is the exact
BPE result when no merge would have crossed any of its boundaries, which only
depends on the two tokens beside each: numpy walks the merge histories of all
adjacent pairs of a batch together. Words with a pair that fails are merged
exactly, by rank.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arraylens.llm.staging import bound_batches, with_text

#: Distinct words, and distinct pieces of words, kept by one Python worker, and the longest one kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Words handled at once.
WORDS = 1 << 18
#: Letters of the longest word that is merged in a block with others.
BLOCK_CHARS = 24
_NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_WHITE = regex.compile(r"\p{White_Space}+")


class Known:
    """Ids of words that were met, as rows of one flat array."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.long: list[str] = []

    def add(self, words: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.row.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), np.int32, lengths.sum()))
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)
        self.long += [w for w in words if len(w) > CACHE_CHARS]

    def trim(self) -> None:
        """Drop everything once long words take the room meant for words."""
        if sum(map(len, self.long)) > CACHE_WORDS:
            self.clear()


class Bpe:
    """A BPE model of the `tokenizers` JSON format with word ends.

    Supported: NFC, white space and lower-case normalisers, one inverted Split
    pattern before ByteLevel, merges with an end-of-word suffix, special tokens.
    """

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.strings = np.array([""] * (max([*self.vocab.values(), *(t["id"] for t in d["added_tokens"])]) + 1), object)
        for s, i in self.vocab.items():
            self.strings[i] = s
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()

        n = len(self.strings)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x, y] = r, z
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.results = np.array([z for _, z in self.merges.values()], np.int64)[order]
        self.letter, self.last = np.full(512, -1), np.full(512, -1)  # ids of letters by code point, and at the end of a word
        for c in self.letters:
            self.letter[ord(c)], self.last[ord(c)] = self.vocab[c], self.vocab[c + self.end]

        # tokens that encode to themselves, children before parents
        made = np.flatnonzero(self.rank >= 0)
        apart = self.compatible(self.left[made], self.right[made], inner=True)
        sound = np.ones(n, bool)
        for t, ok in sorted(zip(made, apart, strict=True), key=lambda x: self.rank[x[0]]):
            sound[t] = ok and sound[self.left[t]] and sound[self.right[t]]
        self.whole = {s: i for s, i in self.vocab.items() if sound[i]}
        self.reach: dict[str, int] = {}  # letters of the longest token that starts with three letters
        for s in self.whole:
            n = len(s) - len(self.end) if self.end and s.endswith(self.end) else len(s)
            if n > 2:
                self.reach[s[:3]] = max(n, self.reach.get(s[:3], 0))
        self.known = Known()
        self.parts: dict[str, list[int]] = {}  # ids of pieces that were met: most new words are known ones beside other marks

    def crossing(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or _NEVER."""
        k = p << 32 | q
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.ranks[i], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether no merge crosses the boundary of x and y while both are built.

        The pieces beside the boundary are unbuilt in the reverse order of their
        merges, the right one first on equal ranks as merges run from the left.
        At each state the crossing merge wins if it comes before the next merge
        of the left piece and not after that of the right piece. inner: the last
        state may merge, as when x and y make a token.
        """
        p, q = np.array(x, np.int64), np.array(y, np.int64)
        up_p, up_q = np.full(len(p), _NEVER), np.full(len(p), _NEVER)
        good = np.ones(len(p), bool)
        at = np.arange(len(p))
        first = inner
        while len(at):
            a, b = p[at], q[at]
            if not first:
                r = self.crossing(a, b)
                bad = (r < up_p[at]) & (r <= up_q[at]) & (r < _NEVER)
                good[at[bad]] = False
                at = at[~bad]
                a, b = p[at], q[at]
            first = False
            ra, rb = self.rank[a], self.rank[b]
            go = (ra >= 0) | (rb >= 0)
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            down_q = rb >= ra
            i, j = at[down_q], at[~down_q]
            up_q[i], q[i] = rb[down_q], self.left[b[down_q]]
            up_p[j], p[j] = ra[~down_q], self.right[a[~down_q]]
        return good

    def greedy(self, s: str) -> list[int] | None:
        """Longest matches from the left of a word in byte letters; None if some part has none."""
        out, i, n, whole, reach, end = [], 0, len(s), self.whole, self.reach, self.end
        while i < n:
            for j in range(min(n, i + reach.get(s[i : i + 3], 2)), i, -1):
                t = whole.get(s[i:j] + end if j == n else s[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def exact(self, words: list[str]) -> list[list[int]]:
        """Merges by rank, from the left on equal ranks; short words as the rows of a matrix, one merge a row at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        flat = self.letter[points]
        flat[ends - 1] = self.last[points[ends - 1]]
        out: list[list[int]] = [[]] * len(words)
        for i in np.flatnonzero(lengths > BLOCK_CHARS):
            out[i] = self.exact_long(flat[ends[i] - lengths[i] : ends[i]].tolist())
        row = np.flatnonzero(lengths <= BLOCK_CHARS)
        if not len(row):
            return out
        col = np.arange(lengths[row].max() + 1)  # the last column stays empty
        n = lengths[row]
        ids = np.where(col < n[:, None], flat[np.minimum((ends[row] - n)[:, None] + col, len(flat) - 1)], -1)
        ranks = np.full(ids.shape, _NEVER)
        ranks[:, :-1] = np.where(col[1:] < n[:, None], self.crossing(ids[:, :-1], ids[:, 1:]), _NEVER)
        while len(row):
            best = ranks.argmin(1)
            at = np.arange(len(row))
            done = ranks[at, best] == _NEVER
            for i, x, k in zip(row[done].tolist(), ids[done].tolist(), n[done].tolist(), strict=True):
                out[i] = x[:k]
            go = ~done
            row, ids, ranks, n, best = row[go], ids[go], ranks[go], n[go] - 1, best[go]
            at = np.arange(len(row))
            made = self.results[np.searchsorted(self.keys, ids[at, best] << 32 | ids[at, best + 1])]
            after = col[:-1] > best[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[at, best] = made
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ranks[at, best] = np.where(best + 1 < n, self.crossing(made, ids[at, best + 1]), _NEVER)
            i = np.flatnonzero(best > 0)
            j = best[i]
            ranks[i, j - 1] = self.crossing(ids[i, j - 1], made[i])
        return out

    def exact_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(r, i, z, a, b) for r, z, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = z, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for h in (prv[i], i):
                if h >= 0 and nxt[h] < n and (m := merges.get((ids[h], ids[nxt[h]]))):
                    heapq.heappush(heap, (m[0], h, m[1], ids[h], ids[nxt[h]]))
        return [t for t in ids if t >= 0]

    def learn(self, pieces: set[str]) -> dict[str, list[int]]:
        """Token ids of each piece."""
        found, cuts = {}, {}
        for w in pieces:
            plain = w.isascii() and w.isprintable()  # letters that stand for themselves
            s = w if plain else "".join([self.letters[b] for b in w.encode()])
            cuts[w] = s, self.greedy(s)
        tried = [(w, ids) for w, (_, ids) in cuts.items() if ids is not None]
        if tried:
            flat = np.fromiter(chain.from_iterable(ids for _, ids in tried), np.int64)
            ends = np.cumsum([len(ids) for _, ids in tried])
            seam = np.ones(len(flat), bool)  # pairs inside a word
            seam[ends - 1] = False
            at = np.flatnonzero(seam)
            pairs, back = np.unique(flat[at] << 32 | flat[np.minimum(at + 1, len(flat) - 1)], return_inverse=True)
            failed = np.zeros(len(flat), np.int64)
            failed[at] = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            wrong = np.add.reduceat(failed, np.append(0, ends[:-1]))
            found = {w: ids for (w, ids), x in zip(tried, wrong, strict=True) if not x}
        left = [w for w in cuts if w not in found]
        return found | dict(zip(left, self.exact([cuts[w][0] for w in left]), strict=True)) if left else found

    def normal(self, text: str) -> str:
        # lower case by single characters: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def spaced(self, text: str) -> list[str]:
        """The words between white space of a plain text, normalised."""
        text = self.normal(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space to str.split alone
            return [w for w in _WHITE.split(text) if w]
        return text.split()

    def pieces(self, word: str) -> list[str]:
        return [word] if word.isalpha() else self.pattern.findall(word)

    def pieces_ids(self, pieces: set[str]) -> dict[str, list[int]]:
        """Token ids of at least these pieces; those met before are not cut again."""
        found = self.learn({p for p in pieces if p not in self.parts})
        if len(self.parts) + len(found) > CACHE_WORDS:
            found |= {p: self.parts[p] for p in pieces if p in self.parts}
            self.parts = {}
        if len(found) > CACHE_WORDS:
            return found
        long = {p: i for p, i in found.items() if len(p) > CACHE_CHARS}
        self.parts.update((p, i) for p, i in found.items() if p not in long)
        return self.parts if not long else {p: long[p] if p in long else self.parts[p] for p in pieces}

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words joined, and how many ids each word has."""
        known = self.known
        new = [w for w in set(words) if w not in known.row]
        if new:
            if len(known.row) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(set(words))
            cut = {w: self.pieces(w) for w in new}
            ids = self.pieces_ids({p for x in cut.values() for p in x})
            known.add(new, [ids[x[0]] if len(x) == 1 else [t for p in x for t in ids[p]] for x in cut.values()])
        at = np.fromiter(map(known.row.__getitem__, words), np.int64, len(words))
        starts, lengths = known.starts[at], known.lengths[at]
        ends = np.cumsum(lengths)
        out = known.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]
        if new:
            known.trim()
        return out, lengths

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and how many ids each text has."""
        out, totals = [], np.zeros(len(texts), np.int64)
        words: list[str] = []
        owners: list[int] = []  # text and number of words of each run in words
        counts: list[int] = []

        def flush() -> None:
            for i in range(0, len(words), WORDS):
                ids, lengths = self.rows(words[i : i + WORDS])
                out.append(ids)
                owner = np.repeat(owners, counts)[i : i + WORDS]
                totals[:] += np.bincount(owner, lengths, len(texts)).astype(np.int64)
            words.clear(), owners.clear(), counts.clear()

        for i, text in enumerate(texts):
            at = 0
            for m in self.cut.finditer(text) if self.cut and text else ():
                run = self.spaced(text[at : m.start()])
                words += run
                owners.append(i), counts.append(len(run))
                flush()
                out.append(np.array([self.special[m.group()]], np.int32))
                totals[i] += 1
                at = m.end()
            run = self.spaced(text[at:] if at else text) if text else []
            words += run
            owners.append(i), counts.append(len(run))
            if len(words) >= WORDS:
                flush()
        flush()
        return np.concatenate([np.zeros(0, np.int32), *out]), totals

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        """As a tokenizer without a decoder does: the token strings, joined by spaces."""
        return " ".join(self.strings[ids])


_loaded: dict[int, Bpe] = {}


def load(definition: str) -> Bpe:
    key = hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(definition)
    return _loaded[key]


def encode_decode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, text) of each row's whole text: its ids, and the text that these ids decode to.

    As `encode` and then `decode`, in one pass: one Python worker a task, with one
    model, and no ids sent back to be decoded.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            flat, lengths = model.encode_all(batch.column(1).to_pylist())
            at = np.append(0, np.cumsum(lengths)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))
            texts = pa.array([model.decode(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, texts], schema=schema)

    return with_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text; tokenizer: path of a JSON definition.

    Null and empty texts have no ids. Strings of special tokens in a text become
    those tokens, as in the library. Repeated rows are encoded alike, null ids
    kept, other columns ignored; an empty table gives an empty table.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            flat, lengths = model.encode_all(batch.column(1).to_pylist())
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=schema)

    return with_text(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of each row; null ids give a null text, no ids an empty one."""
    spark = encoded.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            ids = batch.column(1)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            there = ids.is_valid().to_pylist()
            texts = [model.decode(flat[at[i] : at[i + 1]]) if there[i] else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(schema.field(1).type), pa.array(texts, pa.string())], schema=schema)

    given = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, text string")

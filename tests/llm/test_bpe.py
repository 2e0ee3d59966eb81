import random

import pytest

from arraylens.llm.bpe import Bpe, decode, encode, encode_decode

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return Bpe(f.read())


SAMPLES = [
    "", " ", "The quick brown fox's tail isn't 12345 long!!", "ÉLÈVE ΟΔΥΣΣΕΥΣ İstanbul ẞ ſ", "a<|startoftext|>b<|endoftext|>",
    "<|endoftext|><|endoftext|>", "日本語 テスト 😀😀👨‍👩‍👧", "\x85\xa0 x\x1cy​z", "é 가 ﬁ", "aaaaaaaaaaaaaaa" * 9,
    "ththththth heheh rerere antidisestablishmentarianism", "don't DON'T we'll I'd 'tis", "½ ② Ⅷ x² 10⁻⁹", "\x00\x01\x7f", "!?!?!?...--==++",
]


def test_matches_library(model, library):
    rng = random.Random(3)
    words = ["th", "re", "in", "anti", "ing", "é", "ß", "ñ", "q", "zz", "the", "er", "ly", "ou", "!", "...", "0", "'s", "世", "Σ"]
    texts = SAMPLES + ["".join(rng.choice([*words, " ", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = model.encode(t)
        assert got == want, t
        assert model.decode(got) == library.decode(want, skip_special_tokens=False)


def test_speculation_agrees_with_exact_merging(model):
    rng = random.Random(5)
    words = {"".join(rng.choice("aeionrsthbl") for _ in range(rng.randrange(1, 14))) for _ in range(5000)}
    for w, ids in model.learn(words).items():
        assert ids == model.exact(["".join(model.letters[b] for b in w.encode())])[0]


def test_small_cache(monkeypatch, model, library):
    monkeypatch.setattr("arraylens.llm.bpe.CACHE_WORDS", 3)
    t = "one two three four five one two three four"
    assert model.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_operator(spark, library):
    rows = [(i, t) for i, t in enumerate(SAMPLES)] + [(None, None), (3, "long " * 50000), (3, "long " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as n_tokens")
    found = sorted(((r.doc_id, tuple(r.ids), r.text) for r in decode(encode(df, PATH), PATH).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert found == sorted(want, key=str)
    assert sorted(((r.doc_id, tuple(r.ids), r.text) for r in encode_decode(df, PATH).collect()), key=str) == found
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, PATH).collect() == [] and encode_decode(empty, PATH).collect() == []
    gone = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode(gone, PATH).collect()[0].text is None


def test_known_pieces_are_not_cut_again(monkeypatch, library):
    """Words beside other marks have the pieces of words that were met, whatever is kept of those."""
    with open(PATH, encoding="utf-8") as f:
        model = Bpe(f.read())
    learn, seen = model.learn, []
    monkeypatch.setattr(model, "learn", lambda pieces: seen.extend(pieces) or learn(pieces))
    texts = ["mentouier don't", "mentouier, (mentouier) don't!", "mentouier... erlythti,", "erlythti " + "x" * 70 + ", " + "x" * 70, "y" * 70 + "!", ""]
    for room in (400_000, 3, 0):
        monkeypatch.setattr("arraylens.llm.bpe.CACHE_WORDS", room)
        seen.clear(), model.known.clear(), model.parts.clear()
        for t in texts * 2:
            assert model.encode(t) == library.encode(t, add_special_tokens=False).ids, (room, t)
        if room > 3:
            assert max(map(seen.count, [p for p in seen if len(p) <= 64])) == 1
        assert len(model.parts) <= room and all(len(p) <= 64 for p in model.parts)

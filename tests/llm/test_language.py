import zlib
from collections import Counter

from arraylens.llm.language import grams, identify, ranked


def plain_grams(text):
    out = Counter()
    words, w = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            w += c
        elif w:
            words.append(w)
            w = ""
    line = " " + " ".join(words) + " "
    if words:
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    out[g] += 1
    return out


def pack(g):
    x = 0
    for c in g:
        x = x << 21 | ord(c)
    return x


def test_grams_and_ranks_match_plain_counting():
    for t in ["", "12 !", "a", "Hé, hé! Straße 9", "日本 語x", "the cat sat on the mat " * 5]:
        want = plain_grams(t)
        assert Counter(grams(t).tolist()) == Counter({pack(g): n for g, n in want.items()})
        order = sorted(want, key=lambda g: (-want[g], pack(g)))[:20]
        assert ranked(grams(t), 20).tolist() == [pack(g) for g in order]


def brute(rows, size):
    by = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            by.setdefault(lang, Counter()).update({pack(g): n for g, n in plain_grams(t).items()})
    top = {k: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:size])} for k, c in by.items()}
    out = []
    for i, t, _ in rows:
        c = Counter({pack(g): n for g, n in plain_grams(t or "").items()})
        mine = sorted(c, key=lambda g: (-c[g], g))[:size]
        if not mine or not top:
            out.append((i, "und", 0.0))
            continue
        d = {k: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(mine)) for k, p in sorted(top.items())}
        best = min(d, key=lambda k: d[k])
        out.append((i, best, round(1 - d[best] / (size * len(mine)), 9)))
    return sorted(out, key=str)


TEXT = {
    "en": "the cat and the dog ran over the hill with their friend", "de": "der hund und die katze liefen über den hügel",
    "fr": "le chat et le chien couraient sur la colline avec leur ami",
}


def test_matches_brute_force(spark):
    rows = [(i, " ".join(TEXT[k].split()[i % 4 :] * 3), k) for i in range(30) for k in [list(TEXT)[i % 3]]]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !", None), (None, "the dog", "en"), (3, "der", None), (3, "der", None), (60, "chat " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as n", "3 as rank")
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in identify(df, 40).collect()), key=str)
    assert got == brute(rows, 40)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(df).collect()] == [("und", 0.0)]
    assert identify(df.limit(0)).collect() == []


def test_held_out_accuracy_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).where("held_out").join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97

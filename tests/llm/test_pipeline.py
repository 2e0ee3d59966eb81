"""The pipeline's stages against brute force and against planted cases."""

import random

import corpus_pipeline
from arraylens.llm.staging import table

AT = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_keep_columns_and_drop_only_what_they_find(spark):
    docs = table(spark, AT, "documents")
    rng = random.Random(1)
    vocab = [f"word{i}" for i in range(300)]
    passage = "\n".join(" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(6))
    clean = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(3)]
    leak = table(spark, AT, "benchmark").first().text
    near = clean[0].split()
    near[40] = "changed"
    rows = [
        (9001, clean[0], "en", "x", 1), (9002, " ".join(near), "en", "x", 1), (9003, clean[1] + "\n" + passage, "en", "x", 1),
        (9004, passage + "\n" + clean[2], "en", "x", 1), (9005, clean[1].upper() + " " + leak, "en", "x", 1), (9006, None, None, None, None),
        (9007, "", "en", "x", 0), (None, clean[2] + " more", "en", "x", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]

    good = steps["quality_classifier"](spark, docs, AT)
    assert good.columns == docs.columns
    assert 0.6 < good.count() / docs.count() <= 1

    cut = steps["line_dedup"](spark, docs, AT)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.where("doc_id > 9000").collect()}
    assert passage in texts[9003] and texts[9004] == clean[2] and 9006 in texts and texts[9007] == ""

    near = steps["ngram_jaccard_join"](spark, docs, AT)
    kept = {r.doc_id: shingle_set(r.text) for r in near.collect()}
    assert near.columns == docs.columns and 9001 in kept and 9002 not in kept and 9006 in kept and None in kept
    sets = list(kept.items())
    assert not any(a and b and None not in (i, j) and 5 * len(a & b) >= 4 * len(a | b) for n, (i, a) in enumerate(sets) for j, b in sets[:n])

    clean_docs = steps["benchmark_decontamination"](spark, docs, AT)
    ids = {r.doc_id for r in clean_docs.select("doc_id").collect()}
    assert clean_docs.columns == docs.columns and 9005 not in ids and {9001, 9003, 9006, 9007, None} <= ids

    out = steps["bpe"](spark, docs.where("doc_id > 9000"), AT)
    assert {r.doc_id: r.n_tokens for r in out.collect()}[9006] == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, AT).collect()
    assert len(out) > 50 and all(r.n_tokens == len(r.ids) for r in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _quality double, _removed long, _lines string, _runs int, _n int, _row string"


def odd_rows():
    """Rows with nulls, repeats, ids that stand for several texts, and columns named as the stages' own."""
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    a, b, c = prose(60), prose(70), prose(80)
    texts = [(1, a), (1, b), (1, a + " end"), (2, a), (None, c), (None, c + " more"), (3, c), (4, None), (4, ""), (5, "   "), (None, None), (6, prose(30_000))]
    return [(i, t, None, "s", 7, 0.5, 7, "l", 9, 11, f"r{k}") for k, (i, t) in enumerate(texts)], (a, b, c)


def test_odd_rows_and_clashing_columns(spark):
    rows, (a, b, c) = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    steps = dict(corpus_pipeline.STAGES)
    for name in list(steps)[:4]:
        out = steps[name](spark, docs, AT)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {(r._quality, r._removed, r._lines, r._runs, r._n) for r in got} == {(0.5, 7, "l", 9, 11)}, name
        assert {r._row for r in got} <= {r[-1] for r in rows}
        if name == "ngram_jaccard_join":  # one of each group; other texts of an id stay, texts without words too
            kept = {r._row: (r.doc_id, r.text) for r in got}
            assert {"r1", "r7", "r8", "r9", "r10", "r11"} <= kept.keys()
            groups = [{"r0", "r2", "r3"}, {"r4", "r5", "r6"}]
            assert [len(g & kept.keys()) for g in groups] == [1, 1] and len(kept) == 8
            assert kept[(groups[0] & kept.keys()).pop()][0] == 1 and "r6" in kept
        if name in ("benchmark_decontamination", "line_dedup"):
            assert {"r7", "r8", "r10"} <= {r._row for r in got}
    out = steps["bpe"](spark, docs, AT).collect()
    assert len(out) == len(rows) and sorted(r.n_tokens == 0 for r in out)[-3:] == [True] * 3


def test_a_leak_takes_no_other_text_of_its_id(spark):
    leak = table(spark, AT, "benchmark").first().text
    docs = spark.createDataFrame([(1, "x y z " + leak), (1, "clean words of the same document"), (None, leak), (None, "also clean")], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, AT)
    assert sorted(r.text for r in got.collect()) == ["also clean", "clean words of the same document"]


def test_empty_tables(spark):
    docs = table(spark, AT, "documents").where("doc_id < -1")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, AT)
        assert out.collect() == [] and (name == "bpe" or out.columns == docs.columns)

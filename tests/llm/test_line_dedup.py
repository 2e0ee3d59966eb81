import random

import pytest
from pyspark.sql import functions as F

from arraylens.llm.line_dedup import dedup_lines


def brute(rows, least):
    """Every maximal run that an earlier place also has, by trying all pairs of places."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    full = {}
    for i in order:
        lines = [] if rows[i][1] is None else rows[i][1].split("\n")
        full[i] = [(j, tuple(x.split())) for j, x in enumerate(lines) if x.split()]
    places = [(i, j) for i in order for j in range(len(full[i]))]
    dead = {i: set() for i in order}
    for p, (i, j) in enumerate(places):
        for a, b in places[:p]:
            m = 0
            while j + m < len(full[i]) and b + m < len(full[a]) and full[i][j + m][1] == full[a][b + m][1]:
                m += 1
            if sum(len(full[i][j + x][1]) for x in range(m)) >= least:
                dead[i].update(full[i][j + x][0] for x in range(m))
    out = []
    for i, (d, t) in enumerate(rows):
        lines = [] if t is None else t.split("\n")
        for x in range(1, len(lines)):
            if x - 1 in dead[i] and not lines[x].split():
                dead[i].add(x)
        text = t if not dead[i] else "\n".join(x for n, x in enumerate(lines) if n not in dead[i])
        out.append((d, text, len(lines), len(dead[i])))
    return sorted(out, key=str)


def got(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 as _row", "2 as row", "'c' as rank", "doc_id as x", "1 as n", "3 as _spans", "4 as _Row_")
    out = dedup_lines(df, least)
    assert out.columns == ["doc_id", "text", "_row", "row", "rank", "x", "n", "_spans", "_Row_", "_lines", "_removed", "_runs"]
    found = out.collect()
    assert all(sum(s.last - s.first + 1 for s in r._runs) == r._removed for r in found)
    return sorted(((r.doc_id, r.text, r._lines, r._removed) for r in found), key=str)


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 6), (3, 11)])
def test_matches_brute_force(spark, seed, least):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(9)] + ["", "  "]
    rows = []
    for i in range(40):
        text = [rng.choice(lines) if rng.random() < 0.6 else f"unique {i} {j}" for j in range(rng.randrange(1, 16))]
        rows.append((rng.choice([i, i, 7]), "\n".join(text)))
    passage = [f"passage line {j} of it" for j in range(20)]
    for i in range(5):
        rows.append((100 + i, "\n".join([f"head {i}", *passage[i:], "", f"tail {i}"])))
    rows += [(None, rows[3][1]), (200, None), (201, ""), (202, rows[5][1]), (202, rows[5][1]), (203, "a  b\tc\nd e f\n\nx y z w v u"), (204, "a b c\nd e f\n \nx y z w v u")]
    assert got(spark, rows, least) == brute(rows, least)


def test_long_runs_and_empty_table(spark):
    text = "\n".join(f"line {i}" for i in range(3000))
    rows = [(1, text), (2, text + "\nend"), (3, "word " * 100000), (4, "word " * 100000)]
    found = got(spark, rows, 25)
    assert [(r[0], r[3]) for r in sorted(found)] == [(1, 0), (2, 3000), (3, 0), (4, 1)]
    assert got(spark, [], 25) == []


def test_an_aggregate_gives_the_same_rows_as_its_table(spark, tmp_path):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(9)) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = given.groupBy("doc_id").agg(F.first("text").alias("text"))
    given.write.parquet(f"{tmp_path}/t")
    want = sorted(map(tuple, dedup_lines(spark.read.parquet(f"{tmp_path}/t")).select("doc_id", "text", "_removed").collect()))
    assert sorted(map(tuple, dedup_lines(made).select("doc_id", "text", "_removed").collect())) == want
    assert want == sorted((d, t, n) for d, t, _, n in brute(sorted(rows), 25))


def test_a_run_longer_than_its_first_window_is_one_run(spark):
    text = "\n".join(f"some line number {i} here" for i in range(40))
    found = dedup_lines(spark.createDataFrame([(1, text), (2, f"a\n{text}\nb"), (3, text[:300])], "doc_id long, text string")).collect()
    assert {r.doc_id: [(x.first, x.last) for x in r._runs] for r in found} == {1: [], 2: [(1, 40)], 3: [(0, text[:300].count("\n") - 1)]}

"""Nested metric files from a folder and back, and incremental runs over new files."""

import json

import pytest

from arraylens.sources import manifest, nested

TREES = {
    "a.json": {"final": {"corr": {"(3, 'Jee')": 0.25, "(12, 'Jnn')": float("nan")}, "cross": [[1, 2.5], [], [True, None]]}, "history": "made, NaN by", "gain": {"7": "(1.5-2j)", "8": "3j"}},
    "b.json": {"all_metrics": {"corr": {"0": {"(3, 'Jee')": 1e300}, "1": {"(3, 'Jee')": float("-inf")}}}, "cut": "4.0", "n": 12345678901},
    "c.json": {"Jxx": {"chisq_ant_avg": {"12": [1.0, 2.0]}}, "empty": {}, "ümlaut": "ä\"\n"},
    "d.json": 5,
}


def plain(x, path=()):
    """(path, value) of each leaf."""
    if isinstance(x, (dict, list)):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            yield from plain(v, (*path, k))
    else:
        yield path, x


def typed(r):
    """The value of a row of leaves."""
    return {"string": r.text, "null": None, "boolean": bool(r.re), "complex": complex(r.re or 0, r.im or 0)}.get(r.kind, int(r.re) if r.kind == "long" else r.re)


def key(path, value):
    return tuple(map(str, path)), repr(complex(value.replace(" ", ""))) if isinstance(value, str) and value.rstrip(")").endswith("j") else repr(value)


def rows(df, name):
    return sorted(key([p["key"] if p["key"] is not None else p["at"] for p in r.path], typed(r)) for r in df.where(f"file = '{name}'").collect())


def test_round_trip_over_a_folder(spark, tmp_path):
    given = tmp_path / "given" / "night"
    given.mkdir(parents=True)
    for name, tree in TREES.items():
        (given / name).write_text(json.dumps(tree))
    found = nested.read_trees(spark, str(tmp_path / "given"))
    want = {name: sorted(key(p, v) for p, v in plain(tree)) for name, tree in TREES.items()}
    assert {name: rows(found, name) for name in TREES} == want
    nested.write_trees(found, str(tmp_path / "out"))
    again = nested.read_written(spark, str(tmp_path / "out"))
    assert {name: rows(again, name) for name in TREES} == want
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        nested.write_trees(found, str(tmp_path / "out"))


def test_antennas_iterations_and_places(spark):
    texts = spark.createDataFrame([(n, json.dumps(t)) for n, t in TREES.items()], "file string, text string")
    found = nested.leaves(texts)
    got = {(r.file, r.metric, r.ant, r.antpol, r.iter, tuple(r.place)): (r.value, r.imag) for r in nested.metrics(found).collect()}
    assert got["a.json", "final_corr", 3, "Jee", None, ()] == (0.25, None)
    assert got["a.json", "final_cross", None, None, None, (0, 1)] == (2.5, None)
    assert got["b.json", "all_metrics_corr", 3, "Jee", 1, ()] == (float("-inf"), None)
    assert got["b.json", "cut", None, None, None, ()] == (4.0, None)
    assert got["a.json", "gain", None, None, 7, ()] == (1.5, -2.0)
    by_ant = {(r.file, r.metric, r.ant, tuple(r.place)): r.value for r in nested.metrics(found, "ant").collect()}
    assert by_ant["c.json", "Jxx_chisq_ant_avg", 12, (1,)] == 2.0
    with pytest.raises(Exception, match="no JSON: x"):
        nested.leaves(spark.createDataFrame([("x", "{")], "file string, text string")).collect()


def test_a_second_run_reads_only_new_files(spark, tmp_path):
    data, book, seen = tmp_path / "data", str(tmp_path / "manifest"), []

    def put(name, values):
        part = tmp_path / f"part-{name}"
        spark.createDataFrame([(v,) for v in values], "x int").coalesce(1).write.parquet(str(part))
        data.mkdir(exist_ok=True)
        (file,) = part.glob("*.parquet")
        file.rename(data / f"{name}.parquet")

    def step(rows):
        seen.append(sorted(r.x for r in rows.collect()))

    put("zen.2458043.20", [3]), put("zen.2458043.10", [1, 2])
    files = manifest.listing(spark, str(data)).orderBy("ordinal").collect()
    assert [(r.night, r.ordinal, r.first, r.path.endswith("10.parquet")) for r in files] == [("2458043", 0, True, True), ("2458043", 1, False, False)]
    first = manifest.run_new(spark, str(data), book, step)
    assert sorted(r.rows for r in first.collect()) == [1, 2] and seen == [[1, 2, 3]]
    assert manifest.run_new(spark, str(data), book, step).count() == 0 and len(seen) == 1
    put("zen.2458043.30", [4])
    assert manifest.run_new(spark, str(data), book, step, only_first=True).count() == 0 and len(seen) == 1

    def broken(rows):
        raise OSError("no disk")

    with pytest.raises(OSError):
        manifest.run_new(spark, str(data), book, broken)
    put("zen.2458044.10", [])
    later = manifest.run_new(spark, str(data), book, step, only_first=True)
    assert seen[1:] == [[4]] and {r.path[-18:]: r.rows for r in later.collect()} == {"2458043.30.parquet": 1, "2458044.10.parquet": 0}
    assert manifest.read_manifest(spark, book).count() == 4

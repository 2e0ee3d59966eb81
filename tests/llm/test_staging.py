"""What operators leave on disk: tables that their lazy results read, and no shuffle files of those they wrote."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arraylens.llm import staging
from arraylens.llm.line_dedup import dedup_lines
from arraylens.llm.ngram_join import near_duplicates
from arraylens.llm.staging import CLEANUP, Stage


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "checkpoint_dir", lambda spark: str(tmp_path))
    return tmp_path


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).rglob("shuffle_*")}


def names(shared):
    return sorted(p.name[4:] for p in shared.glob("arraylens/*/*"))


@pytest.mark.parametrize("given", [None, "false", "true"])
def test_a_written_table_leaves_no_shuffle_files(spark, shared, given):
    if given:
        spark.conf.set(CLEANUP, given)
    before = shuffle_files(spark)
    sums = spark.range(0, 20_000, 1, 8).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    out = Stage(spark).keep(sums)
    assert not shuffle_files(spark) - before and out.count() == 100
    left = spark.conf.get(CLEANUP, None)
    spark.conf.unset(CLEANUP)
    assert left == given


def test_operators_keep_only_what_their_results_read(spark, shared):
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    near = near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, "x y"), (4, a)], "doc_id long, text string"))
    assert [n for n in names(shared) if n != "stars"] == ["classes"]
    assert sorted((r.doc_id, r.component_id) for r in near.collect()) == [(1, 1), (2, 1), (3, 3), (4, 1)]


def test_line_dedup_keeps_only_what_its_result_reads(spark, shared):
    passage = "\n".join(f"line {i} of a passage that stands twice" for i in range(6))
    out = dedup_lines(spark.createDataFrame([(1, passage + "\nend"), (2, "start\n" + passage)], "doc_id long, text string"))
    assert names(shared) == ["documents", "spans"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: passage + "\nend", 2: "start"}

"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with
the columns of `documents`; the last returns token ids. Each works on all that
the stage before has kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylens.llm import bpe, decontaminate, line_dedup, quality
from arraylens.llm.ngram_join import near_duplicates
from arraylens.llm.staging import Stage, fresh, table

#: Score below which the classifier rejects a document.
QUALITY = 0.3


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a row number, and that column's name: rows are judged by it, so that rows of one doc_id stay apart."""
    (row,) = fresh(docs.columns, "_row")
    return Stage(spark).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", compression="zstd"), row


def by_row(docs: DataFrame, row: str) -> DataFrame:
    """(doc_id, text) for an operator that is to judge rows: doc_id is the row number."""
    return docs.select(F.col(f"`{row}`").alias("doc_id"), F.col("`text`").alias("text"))


def without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """docs whose row number is not in gone, which grows with the input: hashed on both sides, texts unsorted."""
    gone = gone.select(F.col(gone.columns[0]).alias(row)).hint("shuffle_hash")
    return docs.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns if c != row])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged on its whole text, however long, by itself: null and
    empty texts score as empty ones, repeated rows alike, there are no ties. An
    empty table stays empty; columns of any name stay.
    """
    (name,) = fresh(docs.columns, "_quality")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name).where(F.col(name) >= QUALITY).drop(name)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those with nothing left go. n_chars follows the text.

    Texts of any length are read whole. Null and empty texts stay as they are;
    of repeated rows the first, by doc_id and then as read, keeps its lines. An
    empty table stays empty. Columns of any name stay, those that the operator
    adds under another name meanwhile.
    """
    added = ("_lines", "_removed", "_runs")
    clash = [c for c in docs.columns if c.lower() in added]
    other = dict(zip(clash, fresh([*docs.columns, *added], *[f"{c}_given" for c in clash]), strict=True))
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(other))
    out = out.where(~((F.col("_removed") > 0) & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        n = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.drop(*added).withColumnsRenamed({new: old for old, new in other.items()}).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, of several with it the first read.

    Every row is a document of its own, also where rows share a doc_id: those
    with near texts are one group, those with other texts stay. A null doc_id
    comes after all others. Null, empty and blank texts are in no group and
    stay; texts of any length are compared whole. An empty table stays empty;
    columns of any name stay.
    """
    stage = Stage(spark)
    docs, row = numbered(spark, docs)
    groups = stage.keep(near_duplicates(by_row(docs, row)).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    many = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    members = stage.keep(groups.join(many, "group", "left_semi"), "members")
    stage.drop(groups)
    ids = docs.select(F.col(row).alias("row"), F.col("`doc_id`").cast("long").alias("id"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = members.join(ids, "row").groupBy("group").agg(F.min(place)["row"].alias("row")).select("row")
    return without(docs, row, members.select("row").join(stage.keep(first, "first"), "row", "left_anti"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by itself and its whole text, also where rows share a
    doc_id or it is null. Null and empty texts hold nothing and stay; repeated
    rows go or stay together. An empty table stays empty; columns of any name
    stay.
    """
    docs, row = numbered(spark, docs)
    leaks = decontaminate.find_leaks(by_row(docs, row), table(spark, sf_dir, "benchmark"))
    return without(docs, row, leaks.select("doc_id").distinct())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row; other columns end here.

    Null and empty texts have no ids; texts of any length are encoded whole;
    repeated rows have a row each; an empty table gives an empty one.
    """
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_decode(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("bpe", tokenize),
]

#: No SQL: a classifier, a suffix array and BPE. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stage = Stage(spark)
    for name, step in STAGES[:-1]:
        docs = stage.keep(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Nested metric files: JSON trees of any depth, from many files to rows and back.

Texts are parsed to VARIANT in the executors and opened level by level, so a
folder of files becomes one table of leaves: the keys from the top to the leaf,
and a typed value. The driver only asks whether a level is left.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|nan)"
#: A complex number as Python writes it: real part, imaginary part.
COMPLEX = rf"^\s*\(?\s*([+-]?{_NUMBER}(?=[+-]))?([+-]?{_NUMBER})[jJ]\s*\)?\s*$"
#: A key of an antenna and a feed.
ANTPOL = r"^\(?\s*([0-9]+)\s*,\s*['\"]?([A-Za-z]+)['\"]?\s*\)?$"

LEAVES = "file string, path array<struct<key:string,at:int>>, kind string, re double, im double, text string"


def _parsed(text: Column) -> Column:
    """VARIANT of a text; names of no finite number, which JSON lacks, are read as strings. NULL where nothing can be read."""
    loose = F.regexp_replace(text, r"(?<=[:\[,\s])(-?Infinity|NaN)(?=\s*[,\]}])", '"$1"')
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(loose))


def leaves(texts: DataFrame) -> DataFrame:
    """(file, path, kind, re, im, text) of the leaves of JSON texts (file, text).

    A path lists keys of objects and places in arrays. Kinds are long, double,
    complex (strings that Python writes for complex numbers), boolean, string
    and null; the strings NaN, Infinity and -Infinity are doubles; numbers, booleans and strings of finite or infinite numbers fill
    re. Texts that are no JSON raise an error; empty objects and arrays have no
    leaves.
    """
    spark = texts.sparkSession
    v = _parsed(F.col("text"))
    path = F.array().cast("array<struct<key:string,at:int>>")
    level = texts.select("file", F.when(v.isNull(), F.raise_error(F.concat(F.lit("no JSON: "), "file"))).otherwise(v).alias("v"), path.alias("path"))
    found = None
    while True:
        level = level.withColumn("_kind", F.schema_of_variant("v"))
        open_ = F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY")
        here = level.where(~open_).select("file", "path", "v", "_kind")
        found = here if found is None else found.unionByName(here)
        level = level.where(open_)
        if level.isEmpty():
            break
        level = spark.sql(
            "SELECT file, e.value AS v, concat(path, array(struct(e.key AS key, CASE WHEN e.key IS NULL THEN e.pos END AS at))) AS path FROM {level}, LATERAL variant_explode(v) AS e", level=level
        )
    kind, text = F.col("_kind"), F.try_variant_get("v", "$", "string")
    is_text = kind == "STRING"
    imaginary = F.when(is_text & text.rlike(COMPLEX), F.regexp_extract(text, COMPLEX, 2).try_cast("double"))
    real = F.when(imaginary.isNotNull(), F.coalesce(F.when(F.regexp_extract(text, COMPLEX, 1) != "", F.regexp_extract(text, COMPLEX, 1).try_cast("double")), F.lit(0.0)))
    name = (
        F.when(imaginary.isNotNull(), "complex").when(is_text & text.isin("NaN", "Infinity", "-Infinity"), "double").when(is_text, "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind == "BIGINT", "long").otherwise("double")
    )
    number = F.when(is_text, F.coalesce(real, text.try_cast("double"))).when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).otherwise(F.try_variant_get("v", "$", "double"))
    return found.select("file", "path", name.alias("kind"), number.alias("re"), imaginary.alias("im"), F.when(is_text, text).alias("text"))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of all JSON files under a folder, or of one file; `file` is its name below the folder."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return leaves(texts.select(F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("file"), F.col("value").alias("text")))


def metrics(found: DataFrame, int_keys: str = "iter") -> DataFrame:
    """(file, metric, ant, antpol, iter, place, kind, value, imag, text) of leaves.

    Keys of an antenna and a feed, `(12, 'Jee')`, give ant and antpol; keys of
    digits an iteration, or an antenna where int_keys is `ant`; the other keys
    joined by `_` the metric. place lists the places in arrays.
    """
    keys = F.filter(F.col("path"), lambda p: p["key"].isNotNull())
    names = F.transform(keys, lambda p: p["key"])
    pairs = F.filter(names, lambda k: k.rlike(ANTPOL))
    digits = F.filter(names, lambda k: k.rlike("^[0-9]+$"))
    rest = F.filter(names, lambda k: ~k.rlike(ANTPOL) & ~k.rlike("^[0-9]+$"))
    pair = F.get(pairs, F.lit(0))
    number = F.get(digits, F.lit(0)).cast("int")
    by_pair = F.regexp_extract(pair, ANTPOL, 1).cast("int")
    return found.select(
        "file", F.array_join(rest, "_").alias("metric"), (F.coalesce(by_pair, number) if int_keys == "ant" else by_pair).alias("ant"),
        F.regexp_extract(pair, ANTPOL, 2).alias("antpol"), (F.lit(None).cast("int") if int_keys == "ant" else number).alias("iter"),
        F.transform(F.filter(F.col("path"), lambda p: p["key"].isNull()), lambda p: p["at"]).alias("place"), "kind", F.col("re").alias("value"), F.col("im").alias("imag"), "text",
    )


def _value(kind: str, re: float, im: float, text: str | None):
    if kind == "complex":
        return str(complex(re, im))
    if kind == "string":
        return text
    if kind == "null":
        return None
    return bool(re) if kind == "boolean" else int(re) if kind == "long" else float(re)


def _assembled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The JSON text of one file's leaves."""
    top: dict = {}
    for path, kind, re, im, text in zip(pdf["path"], pdf["kind"], pdf["re"], pdf["im"], pdf["text"], strict=True):
        steps = ["", *(p["key"] if p["key"] is not None else int(p["at"]) for p in path)]
        node = top
        for a in steps[:-1]:
            node = node.setdefault(a, {})
        node[steps[-1]] = _value(kind, re, im, text)

    def closed(x):
        if not isinstance(x, dict):
            return x
        if x and all(isinstance(k, int) for k in x):
            return [closed(x.get(k, {})) for k in range(max(x) + 1)]
        return {k: closed(v) for k, v in x.items()}

    return pd.DataFrame({"file": [pdf["file"].iloc[0]], "text": [json.dumps(closed(top[""]))]})


def texts_of(found: DataFrame) -> DataFrame:
    """(file, text) of leaves, a JSON text for each file; a group is one file."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("text", T.StringType())])
    return found.select("file", "path", "kind", "re", "im", "text").groupBy("file").applyInPandas(_assembled, schema)


def write_trees(found: DataFrame, path: str, overwrite: bool = False) -> None:
    """Leaves as JSON texts, one file each, in folders `name=<file>`. An empty object or array has no leaf: it goes, or is an empty object where others follow it in an array."""
    out = texts_of(found).select(F.col("text").alias("value"), F.col("file").alias("name"))
    out.repartition("name").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("name").option("maxRecordsPerFile", 1).text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of what write_trees has written."""
    return leaves(spark.read.text(path, wholetext=True).select(F.col("name").cast("string").alias("file"), F.col("value").alias("text")))

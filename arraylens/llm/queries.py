"""The registered query of each operator, over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraylens.llm import bpe, decontaminate, embedding_dedup, language, line_dedup, ngram_join, pii, quality, quotes, repeats, resample, sharding, vector_codes
from arraylens.llm.ngram_join import near_duplicates
from arraylens.llm.staging import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.transform("_runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")))
    return out.select(
        "doc_id",
        F.col("_lines").cast("long").alias("n_lines"),
        F.col("_removed").cast("long").alias("n_removed"),
        F.concat_ws(",", runs).alias("removed_runs"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"),
    )


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    body = F.sha2(F.encode(F.coalesce("body", F.lit("")), "utf-8"), 256)
    return out.withColumn("body_sha256", body).drop("body")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(*pii.extract(table(spark, sf_dir, "documents")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quote_linking": op2_quote_linking,
    "op3_decontaminate": op3_decontaminate,
    "op4_ngram_join": op4_ngram_join,
    "op5_language": op5_language,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op11_suffix_array_dedup": repeats.ORACLE,
}

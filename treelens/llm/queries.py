"""The registered ``opN_`` queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.llm import (
    decontaminate, lm, mixing, near_dedup, passages, quality, sharding, suffix_dedup, token_counts, token_store,
    url_rules,
)
from treelens.llm.common import Tables, free, scratch, table

#: Fixed rules of op3: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
SHARDS = 24


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # passages of 50 short words can have fewer than 400 bytes: they are reported, not removed
    shared = Tables(spark, "passages")(passages.sharing(docs))
    free(spark)
    out = suffix_dedup.remove_repeats(docs)
    out = out.withColumn("own", passages.document_key(F.col("doc_id"), F.col("th")))
    out = out.join(shared, F.col("own") == F.col("d"), "left")
    return out.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("d").isNotNull().alias("shares_50_words")
    )


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_store.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.digest(spark, path)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_rules.judge(pages, rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows, m = mixing.plan(docs)
    return rows.select(
        "doc_id", m["size"], m["source_size"], m["target"],
        F.col(m["taken"]).cast("long").alias("taken"),
        F.round(F.get(m["positions"], F.lit(0)), 9).alias("first_position"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sharding.write_shards(docs, scratch(spark, "shards"), SHARDS)
    return back.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        sharding.shard_of(F.col("doc_id"), SHARDS + 1, 17).cast("int").alias("grown_shard"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_token_output, op3_url_filters, op4_lm_scoring, op5_decontamination, op6_minhash_near_dedup,
        op7_mixing, op8_token_counts, op9_quality_rules, op10_sharding,
    )
}

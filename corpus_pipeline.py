"""The corpus pipeline: five stages from raw documents to token files.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows its predecessor
kept; ``run`` writes every stage's result as Parquet in the shared folder and reads
it back as the next stage's input.

Defined results for odd input are those of the operators: null or blank texts are
rejected by the quality rules; repeated rows are judged row by row; an empty
table stays empty through all stages; extra columns of the documents pass through every
stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelens.llm import decontaminate, mixing, near_dedup, quality, token_store
from treelens.llm.common import delete, free, own, scratch, table
from treelens.llm.queries import tokenizer_path

END_ID = 2
#: Near copies share this percentage of their 5-word shingles; with 38 bands of 5 a link
#: at 80 % is missed with a probability below 3e-7.
NEAR_PERCENT, NEAR_BANDS = 80, 38


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate component."""
    return near_dedup.keep_one(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy that the curriculum takes, in training order."""
    return mixing.mixed(docs).select(*own(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in training order, read back: doc_id, start, n_tokens, ids.

    ``docs`` is read from the files of the stage before, whose layout holds the order.
    """
    path = scratch(spark, "pipeline-tokens")
    by = token_store.written_order(docs)
    token_store.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), END_ID, by=by)
    return token_store.read_with_starts(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Stages 2, 3 and 5 have no SQL form; tests check the stages' rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's files are deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        free(spark)
        before = path
    return docs

"""A corpus pipeline from five of the operators in corvane.llm: language, near duplicates, passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and hands the next one what it reads back, so a lost
executor costs one stage's tasks at most and no stage is computed twice.

Defined results, whatever the rows: null and empty texts and texts without a letter go in the first stage; texts of any length count whole;
rows alike in doc_id and text leave one, other rows that share a doc_id are judged by their texts; rows without doc_id stay in the second stage, as
no document is their representative; passages are cut from the later documents only; the mix decides by a hash of doc_id and text, so reruns agree;
columns of the operators' names keep their own values; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, langid, mixing, passages, simhash
from corvane.session import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Documents without letters, or unlike every language in the labels, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. One document of each group of near copies stays; a text goes only with another of its class staying."""
    return simhash.one_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Passages that an earlier document has are cut out."""
    return passages.without_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Each row's count of tokens and digests of its ids and of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", drop_passages),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Language profiles, the LSH forest and BPE aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

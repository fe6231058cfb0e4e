"""From raw documents to token ids: language, exact copies, near copies, the mix, the tokens.

Every stage takes (spark, docs, sf_dir) and returns all that it keeps with the columns of ``documents`` (the last one: the
tokens); its result is written as Parquet and read again as the next one's docs. Nulls in any column, empty and very long
texts, ties, repeated rows and empty tables are handled as the operators state; columns beyond those of ``documents`` are
ignored.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, exact_dedup, langid, mixing, wide_simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a likely language; the model is trained on the documents themselves."""
    return langid.known_language(docs.select(*COLUMNS))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: SimHash over five words, checked by similarity 0.8 or more, no pair lost."""
    return wide_simhash.representatives(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a document taken twice is two rows)."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the bytes they decode to."""
    rows = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(rows, VOCABULARY, public_tokenizers.PATTERN)
    return bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN).select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mix_sources", mixed),
    ("byte_bpe", tokens),
]

#: The cube method draws at random and the other stages iterate, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Remove a table between stages that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between stages go to the shared checkpoint folder.

    A table is removed when the next one is written; the last one stays, since the result reads it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    run_id = uuid.uuid4().hex
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/corpus-{run_id}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

Every stage is one of the operators of ``textlab.llm`` with its production parameters. Between stages the
documents are written as Parquet to the shared checkpoint folder and read again, so a lost executor costs
at most the stage at hand. The first four stages return the columns of ``documents``; the last returns the
encoded documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import bpe_shuffle, decontaminate, exact_dedup, lang_crf, ngram_join
from textlab.llm.common import documents, table
from textlab.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages the model knows: not ``und``, P(known) of one half or more; mixtures of them stay."""
    return lang_crf.keep_known(docs, lang_crf.fit(docs), min_known=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 on five-word shingles, the document with the smallest id."""
    return ngram_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit) of each document, and digests of them and of the decoded text."""
    import public_tokenizers
    ranks = bpe_shuffle.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe_shuffle.encode(docs, ranks, public_tokenizers.PATTERN, with_decoded=True)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near),
          ("decontaminate", clean), ("bpe", tokens)]

#: SQL cannot express the language model or the encoding; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = os.path.join(ensure_checkpoint_dir(spark), "pipeline", f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""From raw documents to token ids: five stages, each one operator of ``termpulse.llm``.

Each stage takes all rows its predecessor kept. ``run`` applies them one after
another; between stages the documents are a table in the shared folder, as a
scheduler would keep them. Rows without an id pass the stages that compare
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse.llm import bpe, decontam, exact_dedup, langid, minhash
from termpulse.llm.common import kept_rows, let_workers_import, table, written

RANKS = "byte_bpe_50k.tiktoken"
#: Words of a run in the near-copies stage; the query op7 takes four.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure."""
    return langid.keep_identified(docs, F.col("text"), F.col("lang"), F.col("source"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return kept_rows(docs, exact_dedup.find_copies(docs), "doc_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return kept_rows(docs, minhash.find_near_copies(docs, size=SHINGLE), "doc_id")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return kept_rows(docs, leaks.select("doc_id", F.lit(False).alias("kept")), "doc_id")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of what they decode to beside that of the text."""
    ranks = public_tokenizers.path(RANKS)
    both = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("language", identify_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_benchmark_leaks),
    ("token ids", encode),
]

#: The stages that fit a model, sample signatures or merge bytes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

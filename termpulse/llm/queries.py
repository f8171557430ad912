"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse.llm import (
    arrow_tokens,
    bpe,
    conversation_repair,
    conversation_trie,
    decontam,
    exact_dedup,
    importance,
    langid,
    minhash,
    pii,
    suffix_array,
    suffix_tree,
    token_counts,
)
from termpulse.llm.common import let_workers_import, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: Documents beyond this many tokens do not fit the training window.
TOKEN_LIMIT = 4096


def query(func: Query) -> Query:
    """Register a query."""

    @wraps(func)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return func(spark, sf_dir)

    _QUERIES[func.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_language(spark, sf):
    """Documents declare a language and name a source, which stands for the host."""
    docs = table(spark, sf, "documents")
    return langid.identify(docs, F.col("text"), F.col("lang"), F.col("source"))


@query
def op1_pages(spark, sf):
    """Pages declare a language in their markup and have a host and an address suffix."""
    pages = table(spark, sf, "pages")
    text = F.regexp_replace("html", "<[^>]*>", " ")
    return langid.identify(pages, text, langid.declared_in(F.col("html")), langid.host_of(F.col("url")), "page_id")


@query
def op2_importance_resampling(spark, sf):
    """The target is good and not toxic; as many rows are drawn as labels call good."""
    labels = table(spark, sf, "labels")
    target = labels.filter("quality = 1 AND toxic = 0")
    share = importance.labelled_share(labels, F.col("quality") == 1)
    return importance.resample(table(spark, sf, "documents"), target, share)


@query
def op3_suffix_trees(spark, sf):
    found = suffix_tree.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op4_personal_data(spark, sf):
    found = pii.find(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *(pii.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op5_byte_bpe(spark, sf):
    """Encode every text, decode the ids, and give digests of both."""
    ranks = public_tokenizers.path(RANKS)
    ids = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, packed=True)
    both = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_arrow_tokens(spark, sf):
    """Write the ids of all documents to Arrow files, and describe each from them."""
    path = public_tokenizers.path(VOCABULARY)
    manifest = arrow_tokens.write_sequences(table(spark, sf, "documents"), path, end_id=2)
    return arrow_tokens.read_documents(manifest, "long")


@query
def op7_minhash_near_dedup(spark, sf):
    return minhash.find_near_copies(table(spark, sf, "documents"))


@query
def op8_token_counts(spark, sf):
    counts = token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path(PIECES))
    return counts.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


@query
def op9_exact_dedup(spark, sf):
    return exact_dedup.find_copies(table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query
def op10_decontamination(spark, sf):
    found = decontam.flag(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_items", F.array_join("items", ",").alias("items"), "kept")


@query
def op11_suffix_array(spark, sf):
    found = suffix_array.remove_repeats(table(spark, sf, "documents"))
    spans = (F.size("spans") / 2).cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", spans, "kept_sha256")


@query
def op12_conversation_repair(spark, sf):
    rows = conversation_repair.damaged(table(spark, sf, "conversations"))
    return conversation_repair.repair(rows, present=F.col("present"))


@query
def op13_conversation_trie(spark, sf):
    found = conversation_trie.sequences(table(spark, sf, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.sharing_heads(found))

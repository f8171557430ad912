"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing
columns, and an empty table."""

import public_tokenizers
import pytest
from llm.conftest import ODD, PIECES, RANKS, VOCABULARY
from pyspark.sql import functions as F

import corpus_pipeline
from termpulse.llm import (
    arrow_tokens,
    bpe,
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


def _bench(docs):
    return docs.sparkSession.createDataFrame([(1, None), (2, ""), (3, "too short")], "item_id long, text string")


def _good(docs):
    return docs.sparkSession.createDataFrame([(1,), (1,), (None,)], "doc_id long")


PER_ROW = {
    "language": lambda d: langid.identify(d, F.col("text"), F.col("lang"), F.col("source")),
    "importance": lambda d: importance.resample(d, _good(d), 0.5),
    "suffixes": suffix_tree.remove_repeats,
    "personal data": pii.find,
    "redaction": pii.redact,
    "encoding": lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN),
    "decoding": lambda d: bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN),
    "files": lambda d: arrow_tokens.read_documents(arrow_tokens.write_sequences(d, VOCABULARY, 2), "long"),
    "near copies": minhash.find_near_copies,
    "counts": lambda d: token_counts.count_tokens(d, PIECES),
    "exact copies": exact_dedup.find_copies,
    "leaks": lambda d: decontam.flag(d, _bench(d)),
    "byte strings": suffix_array.remove_repeats,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, odd):
    found = PER_ROW[name](odd)
    ids = sorted(str(r.doc_id) for r in found.select("doc_id").collect())
    assert ids == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, no_docs):
    assert PER_ROW[name](no_docs).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, odd, no_docs, sf):
    found = stage(spark, odd, sf)
    assert stage(spark, no_docs, sf).count() == 0
    if stage is not corpus_pipeline.encode:
        assert found.columns == odd.columns
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    if stage is corpus_pipeline.identify_language:
        assert 4 not in ids and 5 not in ids and 6 not in ids and 1 in ids and 7 in ids
    if stage is corpus_pipeline.drop_exact_copies:
        assert 1 not in ids and ids.count(2) == 2 and ids.count(None) == 2 and 4 not in ids and 5 in ids
    if stage is corpus_pipeline.drop_near_copies:
        assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and ids.count(None) == 2

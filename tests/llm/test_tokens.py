"""Encoding, counting and token files against the libraries on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import ODD, PIECES, RANKS, VOCABULARY
from tokenizers import Tokenizer

from termpulse.llm import arrow_tokens, bpe, token_counts

BITS = [
    "a", "b", "the", " ", "  ", "\n", "'s", "'", "1", "23", ".", "é", "ß", "日", "本", "\x1c", "\x85", "\xa0",
    "😀", "!", "word", "\t", "Z", "▁", "<s>", "<|endoftext|>", "×", "ª",
]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 4, 16])
def test_parts_encode_like_the_whole_text(size):
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)
    for text in texts(800, size):
        assert "".join(bpe.parts(text, size)) == text
        assert bpe.encode_text(encoding, text, size).tolist() == encoding.encode_ordinary(text)


def test_round_trip(spark, odd):
    for packed in (True, False):
        ids = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, packed=packed, part_chars=1000)
        back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN)
        got = sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect())
        assert got == sorted((str(r[0]), (r[1] or "").encode()) for r in ODD)


def test_one_pass_gives_the_same(odd):
    one = bpe.encode_and_decode(odd, RANKS, public_tokenizers.PATTERN, part_chars=1000)
    two = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN, packed=True), RANKS, public_tokenizers.PATTERN)
    rows = [sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in df.collect()) for df in (one, two)]
    assert rows[0] == rows[1] and len(rows[0]) == len(ODD)


def test_ids_that_end_inside_a_character(spark):
    encoding = bpe.load(RANKS, public_tokenizers.PATTERN)
    cut = encoding.encode_ordinary("日本")[:-1]
    row = bpe.decode(spark.createDataFrame([(1, cut), (2, None)], "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN)
    found = {r.doc_id: bytes(r.decoded) for r in row.collect()}
    assert found == {1: encoding.decode_bytes(cut), 2: b""}


@pytest.mark.parametrize("chunk, overlap", [(4, 1), (8, 2), (16, 4)])
def test_spliced_counts_are_those_of_the_whole_text(chunk, overlap):
    counter = token_counts.load(PIECES)
    for text in texts(800, chunk):
        assert counter.count(text, chunk, overlap) == len(counter.model.encode(text))


def test_counts(odd):
    counter = token_counts.load(PIECES)
    rows = token_counts.count_tokens(odd, PIECES, chunk=1000, overlap=8).collect()
    expected = sorted((str(r[0]), len((r[1] or "").encode()), len(counter.model.encode(r[1] or ""))) for r in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == expected


def test_pieces_encode_like_the_library():
    encoder, library = arrow_tokens.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in [*texts(800), "plain words, don't they? 12 34!", "  two  spaces \n\n end "]:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_order(spark, odd):
    library = Tokenizer.from_file(VOCABULARY)
    manifest = arrow_tokens.write_sequences(odd, VOCABULARY, end_id=2, length=64)
    rows = sorted(arrow_tokens.read_documents(manifest, "long").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ODD), key=lambda i: -1 if i is None else i)
    known = {(str(i), len(ids := library.encode(t or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in ODD}
    start = 0
    for r in rows:
        assert r.start == start and (str(r.doc_id), r.n_tokens, r.ids_crc32) in known
        start += r.n_tokens
    for m in manifest.collect():
        shard = arrow_tokens.Shard(m.path)
        n = sum(shard.seq.get_batch(k).num_rows for k in range(shard.seq.num_record_batches))
        ids, mask = zip(*(shard.sequence(i) for i in range(n)), strict=True)
        assert all(len(x) == 64 for x in ids) and sum(int(x.sum()) for x in mask) == m.n_tokens
        assert all(x.all() for x in mask[:-1])
        flat = np.concatenate(ids)[np.concatenate(mask)]
        parts = np.concatenate([p for _, _, pieces in shard.documents() for p in pieces])
        assert (flat == parts).all()

"""Byte-level BPE encoding and decoding with a local rank file (tiktoken).

``encode`` turns whole texts into token ids, ``decode`` turns ids back into raw
bytes. Long texts are encoded in parts: the text is cut only at positions where
the pre-splitting pattern must start a new match, so that the ids are those of
the whole text. Memory per task is one Arrow batch and one part.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to no bytes; repeated rows are encoded row by row; an empty table gives an empty
table; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm.common import text_batches

# Texts beyond this many characters are encoded in parts.
PART_CHARS = 1 << 18

#: Where every match of the pattern ends: before white space that follows a
#: visible character (no alternative holds white space after anything else), and
#: between letters and digits. An apostrophe before letters is no safe place.
SAFE_CUT = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n\t\r])|(?<=\p{L})(?=[0-9])|(?<=[0-9])(?=\p{L})")


@lru_cache(maxsize=4)
def load(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: a base64 token and its rank on each line."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a text at safe places, each part at least ``size`` characters but the last."""
    found, start = [], 0
    while len(text) - start > size and (cut := SAFE_CUT.search(text, start + size)):
        found.append(text[start : cut.start()])
        start = cut.start()
    return [*found, text[start:]]


def encode_text(encoding: tiktoken.Encoding, text: str, size: int = PART_CHARS) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    ids = [encoding.encode_to_numpy(part, disallowed_special=()) for part in parts(text, size)]
    return np.concatenate(ids).astype("<u4", copy=False)


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    packed: bool = False,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``id_col`` and ``ids`` of every row.

    ``ids`` is an array of ints, or with ``packed`` the same ids as one binary of
    little-endian unsigned 32-bit integers. ``ranks_path`` must be readable on
    every executor. Nothing is shuffled.
    """

    def run(batches):
        encoding = load(ranks_path, pattern)
        for batch in text_batches(batches):
            rows = [encode_text(encoding, t or "", part_chars) for t in batch.column(1).to_pylist()]
            if packed:
                ids = pa.array([r.tobytes() for r in rows], pa.binary())
            else:
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                flat = np.concatenate(rows) if rows else np.empty(0, "<u4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, ids {'binary' if packed else 'array<int>'}")
    return out.withColumnRenamed("id", id_col)


def decode(
    encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``id_col``, ``ids_col`` and ``decoded``: the raw bytes that the ids stand for.

    Takes packed ids and arrays. Bytes are not interpreted, so ids that stop in
    the middle of a character decode as well; null ids decode to no bytes. An id
    that is not in the rank file is an error.
    """
    is_packed = encoded.schema[ids_col].dataType.simpleString() == "binary"

    def run(batches):
        encoding = load(ranks_path, pattern)
        for batch in text_batches(batches):
            values = batch.column(1).to_pylist()
            if is_packed:
                values = [np.frombuffer(v or b"", "<u4").tolist() for v in values]
            data = pa.array([encoding.decode_bytes(v or []) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], names=["id", "ids", "decoded"])

    kinds = [encoded.schema[c].dataType.simpleString() for c in (id_col, ids_col)]
    narrow = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = narrow.mapInArrow(run, f"id {kinds[0]}, ids {kinds[1]}, decoded binary")
    return out.withColumnsRenamed({"id": id_col, "ids": ids_col})


def encode_and_decode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``id_col, ids, decoded``: packed ids and the bytes they stand for.

    The rows of ``decode(encode(...))`` from one Python process per task, not two:
    for executors with little memory beside the heap.
    """

    def run(batches):
        encoding = load(ranks_path, pattern)
        for batch in text_batches(batches, 64, 1 << 20):
            rows = [encode_text(encoding, t or "", part_chars) for t in batch.column(1).to_pylist()]
            ids = pa.array([r.tobytes() for r in rows], pa.binary())
            data = pa.array([encoding.decode_bytes(r.tolist()) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, data], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)

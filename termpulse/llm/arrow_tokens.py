"""Token ids in Arrow files of equal-length sequences, with random access.

Documents are dealt out by ranges of their id, sorted, encoded (tokenizers
library), each closed by an end id, and written by the task that holds the range:
one shard per task, in the shared folder. A shard is two Arrow files:

* ``*.seq.arrow``: record batches of ``input_ids`` and ``mask``, both fixed-size
  lists of ``length`` values, so that sequence i of a memory-mapped shard is a
  slice without a copy. Only a shard's last sequence is padded; its mask is false
  there.
* ``*.doc.arrow``: id, start and length of every document, in ids of the shard.

A task writes under a name of its own attempt and reports it in a manifest row;
the manifest is a Spark table, so it names the files of exactly one attempt of
each task, and files of lost or repeated attempts are never read.

Defined cases: a null text counts as empty; an empty text is the end id alone;
null ids sort first; repeated ids stand next to each other; an empty table gives
an empty manifest; other columns are left out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termpulse.llm.bpe import parts
from termpulse.llm.common import text_batches, written
from termpulse.storage import new_folder

LENGTH = 2048
#: Sequences per record batch.
BATCH_SEQUENCES = 256
#: Distinct pieces whose ids a task keeps; beyond this it starts again.
CACHED_PIECES = 400_000

# Characters on which this pattern and the library's own agree in every version.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]*")
_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ſ0-9]+|\s+(?!\S)|\s+"
)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Packed ids of a piece, asked of the library's model once."""

    def __init__(self, tokenizer: Tokenizer):
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize("".join([self.letters[b] for b in piece.encode()]))
        packed = np.array([t.id for t in tokens], "<u4").tobytes()
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[piece] = packed
        return packed


class Encoder:
    """A tokenizer file. Texts of plain characters are split here, piece by piece,
    and each distinct piece is encoded once; any other text goes to the library whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if _PLAIN.fullmatch(text) and not self.added.search(text):
            get = self.pieces.__getitem__
            return b"".join([b"".join(map(get, _PIECE.findall(part))) for part in parts(text)])
        ids = [self.tokenizer.encode(part, add_special_tokens=False).ids for part in parts(text)]
        return b"".join(np.array(x, "<u4").tobytes() for x in ids)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


class _ShardWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, folder: str, name: str, length: int, wide: bool, id_type: pa.DataType):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.path, self.length = f"{root}/{name}", length
        self.kind = np.dtype("<u4" if wide else "<u2")
        value = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema({"input_ids": pa.list_(value, length), "mask": pa.list_(pa.bool_(), length)})
        self.docs = pa.schema({"id": id_type, "start": pa.int64(), "n_tokens": pa.int64()})
        self.streams = [self.fs.open_output_stream(f"{self.path}.{k}.arrow") for k in ("seq", "doc")]
        self.seq, self.doc = (
            pa.ipc.new_file(s, schema) for s, schema in zip(self.streams, (self.schema, self.docs), strict=True)
        )
        self.waiting, self.n_waiting, self.n_tokens, self.n_docs = [], 0, 0, 0

    def add(self, ids: list[np.ndarray], doc_ids: pa.Array) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.doc.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.docs))
        self.n_docs += len(ids)
        self.n_tokens += int(sizes.sum())
        self.waiting += [x.astype(self.kind) for x in ids]
        self.n_waiting += int(sizes.sum())
        if self.n_waiting >= self.length * BATCH_SEQUENCES:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.kind)
        block = self.length * BATCH_SEQUENCES
        whole = len(flat) if last else len(flat) // block * block
        for at in range(0, whole, block):
            ids = flat[at : min(at + block, whole)]
            pad = -len(ids) % self.length
            mask = np.arange(len(ids) + pad) < len(ids)
            ids = np.concatenate([ids, np.zeros(pad, self.kind)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.seq.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.waiting = [flat[whole:]]
        self.n_waiting = len(flat) - whole

    def close(self) -> None:
        self._write(last=True)
        for x in (self.seq, self.doc, *self.streams):
            x.close()


def write_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    folder: str | None = None,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending order of id; return the manifest.

    Manifest, one row per shard: ``shard, path, first_token, n_tokens, n_docs``;
    ``first_token`` counts the ids of all shards before. ``folder`` must be one
    that every executor reaches through a path or a URI that Arrow knows; by
    default it is a new one in the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "arrow")
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        shard, writer = TaskContext.get().partitionId(), None
        encoder = load(tokenizer_path)
        wide = max(encoder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_batches(batches):
            if writer is None:
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                writer = _ShardWriter(folder, name, length, wide, batch.column(0).type)
            packed = [encoder.encode(t) + end for t in batch.column(1).to_pylist()]
            writer.add([np.frombuffer(p, "<u4") for p in packed], batch.column(0))
        if writer is not None:
            writer.close()
            row = [[shard], [f"{folder.rstrip('/')}/{name}"], [writer.n_tokens], [writer.n_docs]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, row)), names=["shard", "path", "n_tokens", "n_docs"])

    # Sorted ranges: shards follow each other in order of id.
    ordered = narrow.repartitionByRange("id").sortWithinPartitions("id")
    shards = written(ordered.mapInArrow(run, "shard long, path string, n_tokens long, n_docs long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # One row per file: a few bytes for each gigabyte of text.
    return shards.select("shard", "path", F.coalesce(before, F.lit(0)).alias("first_token"), "n_tokens", "n_docs")


class Shard:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, path: str):
        self.seq, self.doc = (pa.ipc.open_file(self._open(f"{path}.{k}.arrow")) for k in ("seq", "doc"))
        self.length = self.seq.schema.field("input_ids").type.list_size

    @staticmethod
    def _open(uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (no copy) and mask of sequence ``i``."""
        ids, mask = self.seq.get_batch(i // BATCH_SEQUENCES).columns
        at = slice(i % BATCH_SEQUENCES * self.length, (i % BATCH_SEQUENCES + 1) * self.length)
        return ids.values.to_numpy()[at], mask.values[at].to_numpy(zero_copy_only=False)

    def documents(self):
        """Per document: id, start, and its ids in one piece or, across batches, more."""
        block, number, flat = self.length * BATCH_SEQUENCES, -1, None
        for k in range(self.doc.num_record_batches):
            batch = self.doc.get_batch(k)
            for i, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces, at = [], start
                while at < start + n:
                    if at // block != number:
                        number = at // block
                        flat = self.seq.get_batch(number).column(0).values.to_numpy()
                    pieces.append(flat[at % block : min(block, start + n - number * block)])
                    at += len(pieces[-1])
                yield i, start, pieces


def read_documents(manifest: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``id_col, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it in all shards. The CRC is
    taken over the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, shard = [], Shard(path)
                kind = shard.doc.schema.field("id").type
                for i, start, pieces in shard.documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    rows.append((i, first + start, sum(map(len, pieces)), crc))
                    if len(rows) == 4096:
                        yield _batch(rows, kind)
                        rows = []
                if rows:
                    yield _batch(rows, kind)

    def _batch(rows, kind):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, *[pa.int64()] * 3), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    files = manifest.select("path", "first_token").repartition(n, "path")
    out = files.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)



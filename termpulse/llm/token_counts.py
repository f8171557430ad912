"""Token counts of whole texts, huge ones by overlapping chunks (sentencepiece).

Texts up to ``chunk`` characters are encoded at once. A longer one is encoded in
chunks that overlap. Two neighbouring chunks are spliced at a boundary that is

* proven stable: no piece of the vocabulary holds the two characters next to it
  in this order, so no merge can ever cross it, whatever stands around; and
* common: a token starts there in both chunks, by the offsets of their tokens.

If a chunk has no proven boundary it grows; if the next chunk has no token start
at the boundary, the overlap is widened and that chunk is encoded again. In the
worst case a chunk grows to the whole text, which is then counted at once.

Defined cases: a null text counts as empty; an empty text has 0 tokens and 0
bytes; repeated rows are counted row by row; an empty table gives an empty table;
other columns of the input are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm.common import text_batches

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256
SPACE = "▁"  # fixed value: how pieces write a space


class Counter:
    """A model and the character pairs that its pieces hold."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def proven(self, text: str, at: int) -> bool:
        """Whether no merge can join the characters before and after ``at``."""
        left, right = text[at - 1], text[at]
        if left == " " or left == SPACE:  # runs of spaces are one space to the model
            return False
        return left + (SPACE if right == " " else right) not in self.inside

    def starts(self, text: str) -> list[int]:
        """Start of every token, in characters, ascending."""
        encoded = self.model.encode(text, return_type="proto")
        begins = [p.begin for p in encoded.pieces]
        if len(text) == len(raw := text.encode()):
            return begins
        # Offsets count bytes: the character of a byte is the number of lead bytes up to it.
        chars, seen, at = [], 0, 0
        for begin in begins:
            seen += sum(1 for b in raw[at:begin] if b & 0xC0 != 0x80)
            at = max(at, begin)
            chars.append(seen)
        return chars

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        done, total, size, left = 0, 0, chunk, overlap
        while True:
            first = max(0, done - left)
            end = min(len(text), done + size)
            starts = self.starts(text[first:end])
            new = bisect_left(starts, done - first) if done else 0
            aligned = not done or first == 0 or (new < len(starts) and starts[new] == done - first)
            if not aligned and text[done] == " ":
                # Spaces belong to the token after them, whose start may be any of them.
                after = next((i for i in range(done, end) if text[i] != " "), end)
                aligned = new == len(starts) or starts[new] <= after - first
            if not aligned:
                left *= 2
                continue
            if end == len(text):
                return total + len(starts) - new
            known = set(starts)
            cut = next(
                (at for at in range(end - 1, done, -1) if self.proven(text, at) and (at - first in known or text[at] == " ")),
                None,
            )
            if cut is None:
                size *= 2
                continue
            total += bisect_left(starts, cut - first) - new
            done, size, left = cut, chunk, overlap


@lru_cache(maxsize=2)
def load(model_path: str) -> Counter:
    return Counter(model_path)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row; nothing is shuffled.

    ``model_path`` must be readable on every executor.
    """

    def run(batches):
        counter = load(model_path)
        for batch in text_batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter.count(t, chunk, overlap) if len(t) > chunk else -1 for t in texts]
            short = [t for t, n in zip(texts, counts, strict=True) if n < 0]
            ids = iter(counter.model.encode(short, num_threads=1) if short else [])
            counts = [len(next(ids)) if n < 0 else n for n in counts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)

"""Where Python code sees data, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from termpulse.functions.text import Tokenizer

#: Texts, and characters of text, whose words are held as Python lists at once.
TEXTS, CHARACTERS = 64, 1 << 20
#: Words that are counted at once, but for a single text with more.
WORDS = 1 << 19


def python_tokenizer(func: Callable[[str], list[str]]) -> Tokenizer:
    """Wrap ``str -> list[str]`` for use as a tokeniser.

    ``func`` reaches each worker once, so a segmenter that loads a dictionary
    does so once per worker, not per row. Null and empty text give no words.
    Words leave the worker after every few texts, so its memory does not grow with
    the number of texts that Spark sends at once.
    """

    def batches(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            words, size = [], 0
            for text in (t.as_py() for t in texts):
                words.append(list(func(text)) if text else [])
                size += len(text or "")
                if len(words) == TEXTS or size >= CHARACTERS:
                    yield pa.array(words, pa.list_(pa.string()))
                    words, size = [], 0
            if words:
                yield pa.array(words, pa.list_(pa.string()))

    return F.arrow_udf(batches, "array<string>")


def decodes_as_gbk():
    """A function column: whether raw bytes are well-formed GBK."""

    def batches(raws: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def ok(raw) -> bool:
            try:
                bytes(raw).decode("gbk")
            except UnicodeDecodeError:
                return False
            return True

        for series in raws:
            yield pd.Series([ok(raw) for raw in series], dtype=bool)

    return F.pandas_udf(batches, "boolean")


def leading_words(
    frequent: Broadcast[pa.Table], k: int, highest: float | None
) -> Callable[[Column], Column]:
    """A function column: ``array<struct<word, share, weight>>`` of an array of words.

    ``share`` is the part of the words that are this one, ``weight`` is share times the value
    in ``frequent`` (``word, value``). Words whose weight is less than the k-th by more than
    rounding to six decimals can change are left out. Words that are not in ``frequent``
    have no weight; ``highest`` is the highest value they can have, or None if they have none.
    """

    def batches(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, value = (frequent.value[c].combine_chunks() for c in ("word", "value"))
        for lists in arrays:
            for part in _parts(lists):
                yield _leading(part, known, value, k, highest)

    return F.arrow_udf(batches, "array<struct<word: string, share: double, weight: double>>")


def _parts(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Slices of about ``WORDS`` words."""
    ends = np.cumsum(_lengths(lists))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + WORDS, "right")), start + 1)
        yield lists.slice(start, end - start)
        start = end


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _leading(
    lists: pa.ListArray, known: pa.Array, value: pa.Array, k: int, highest: float | None
) -> pa.ListArray:
    lengths = _lengths(lists)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices
    texts = np.repeat(np.arange(len(lists)), lengths)[codes.is_valid().to_numpy(zero_copy_only=False)]
    # One number for a text and a word of it, in the order of the texts.
    pairs, counts = np.unique(texts * max(len(words), 1) + codes.drop_null().to_numpy(), return_counts=True)
    texts, codes = np.divmod(pairs, max(len(words), 1))
    values = value.take(pc.index_in(words, known.cast(words.type))).to_numpy(zero_copy_only=False)[codes]
    found = ~np.isnan(values)
    share = counts / lengths[texts]
    weight = share * values
    at = np.flatnonzero(found)
    at = at[np.lexsort((-weight[at], texts[at]))]
    firsts = np.searchsorted(texts[at], np.arange(len(lists) + 1))
    least = np.full(len(lists), -np.inf)
    if k > 0:
        enough = np.flatnonzero(np.diff(firsts) >= k)
        least[enough] = weight[at[firsts[enough] + k - 1]] - 2e-6
    most = weight if highest is None else np.where(found, weight, share * highest)
    kept = np.flatnonzero(most >= least[texts])
    rows = pa.StructArray.from_arrays(
        [words.take(pa.array(codes[kept])), pa.array(share[kept]), pa.array(weight[kept], mask=~found[kept])],
        ["word", "share", "weight"],
    )
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(texts[kept], np.arange(len(lists) + 1)), pa.int32()), rows
    )

"""Repeated passages: prefix-partitioned suffix trees over anchored suffixes.

A passage of ``WINDOW`` words is a repeat if it also stands in another document.
A suffix tree over all suffixes of all texts would hold each word with all that
follows it; three things keep the trees small.

* **Anchors.** Of the runs of ``PREFIX`` words inside a window the one with the
  smallest hash is its anchor. Equal windows have the same anchor at the same place,
  so only suffixes that start at anchors are indexed, one for about five words, and
  only anchors that stand in several documents.
* **Prefixes of variable length.** Suffixes are dealt out by their first ``PREFIX``
  words, the anchor, so each group fits into memory. A prefix with more than
  ``GROUP`` windows is too short: there the prefix is the whole window, and each
  task sends on one document per window, the smallest. Such prefixes are at most
  ``MAX_LONG``, the most frequent ones.
* **Subtrees.** A group's tree is built top down, a word at a time, for all groups
  that a task holds at once. A node at depth d that has the same ``WINDOW - d``
  words to the left of its leaves, too, is a repeat of ``WINDOW`` words, and its
  leaf with the smallest id is where it stays. Longer repeats are chains of such
  windows: ``maximal_spans`` merges them.

Words are runs without ASCII white space, compared unchanged.

Defined cases: a null text has no words; a document with fewer words than a window
keeps them all; a passage that repeats inside one document only stays; rows that
repeat an id do not remove each other's words; rows without an id keep all their
words and remove none; an empty table gives an empty table; other columns are left
out. Ids are integers.
"""

from __future__ import annotations

from itertools import compress
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm import wordhash
from termpulse.llm.common import text_batches, written

WINDOW = 13
PREFIX = 6
#: Runs of PREFIX words in a window.
STARTS = WINDOW - PREFIX + 1
GROUP = 50_000
MAX_LONG = 100_000
_SEVERAL = np.uint32(1 << 31)  # marks a count over several documents
#: Anchors that a task sorts at once, and suffixes whose trees it builds at once.
CHUNK = 400_000
SUFFIXES = 50_000
#: Documents to a bucket of anchors.
BUCKET_DOCS = 2_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    low, reach = values, 1
    while reach * 2 <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    rest = width - reach
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of PREFIX words, and the smallest of each window."""
    grams = wordhash.runs(hashes, PREFIX)
    return grams, sliding_min(grams, STARTS) if len(hashes) >= WINDOW else grams[:0]


def _planes(values: np.ndarray) -> bytes:
    """Little-endian values, byte by byte: equal bytes stand together and compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


_PACKED = "bucket long, known boolean, hashes binary, docs binary, counts binary"


def _packed_anchors(rows: DataFrame, bits: int) -> DataFrame:
    """Anchors of each document, packed by leading bits of their hash.

    What a task sees in several documents is known to be shared: it is listed as
    such, and only one entry goes on to meet the other tasks.
    """
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def packed(bucket, known, hashes, docs, counts):
        return bucket, known, _planes(hashes), _planes(docs), _planes(counts)

    def flush(hashes, docs, counts):
        order = np.lexsort((docs, hashes))
        hashes, docs, counts = hashes[order], docs[order], counts[order]
        first = _firsts(hashes)
        last = np.append(first[1:], len(hashes))
        several = docs[first] != docs[last - 1]
        lengths = last - first
        shared = np.repeat(several, lengths)
        rows = []
        # Known ones only pass through the shuffle: any bucket will do.
        for at in range(0, int(shared.sum()), 1 << 16):
            h, d = hashes[shared][at : at + (1 << 16)], docs[shared][at : at + (1 << 16)]
            rows.append(packed(int(d[0]) % (1 << bits), True, h, d, np.empty(0, np.uint32)))
        n = np.minimum(np.add.reduceat(counts, first), _SEVERAL - np.uint32(1)).astype(np.uint32)
        h, d, n = hashes[first], docs[first], n | np.where(several, _SEVERAL, np.uint32(0))
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.append(_firsts(bucket), len(h))
        for a, b in zip(edges, edges[1:], strict=False):
            rows.append(packed(int(bucket[a]), False, h[a:b], d[a:b], n[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    def run(batches):
        waiting, n_waiting = [], 0
        for batch in text_batches(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, windows = np.unique(anchors(wordhash.words((text or "").encode())[2])[1], return_counts=True)
                if len(found):
                    waiting.append((found, np.full(len(found), i, np.int64), windows))
                    n_waiting += len(found)
            if n_waiting >= CHUNK:
                yield flush(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, n_waiting = [], 0
        if waiting:
            yield flush(*map(np.concatenate, zip(*waiting, strict=True)))

    return rows.select("id", "text").mapInArrow(run, _PACKED)


def _by_key(batches, key: str, enough: int = 0):
    """Tables of whole groups of equal keys, which stand together; of at least
    ``enough`` rows, but for the last."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        start = 0
        if waiting and waiting[-1].column(key)[waiting[-1].num_rows - 1].as_py() != keys[0] and sum(b.num_rows for b in waiting) >= enough:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for cut in (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist():
            if sum(b.num_rows for b in waiting) + cut - start >= enough:
                waiting.append(batch.slice(start, cut - start))
                yield pa.Table.from_batches(waiting)
                waiting, start = [], cut
        waiting.append(batch.slice(start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def shared_anchors(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """``id, anchor``: anchors that stand in several documents, for each of these;
    and ``null, anchor, n`` for the anchors of more than ``group`` windows."""
    bits = min(20, max(6, ceil(log2(max(1, rows.count() / BUCKET_DOCS)))))
    dealt = _packed_anchors(rows, bits).repartition("bucket").sortWithinPartitions("bucket")

    def result(docs, hashes, n=None):
        counts = pa.nulls(len(hashes), pa.int64()) if n is None else pa.array(n.astype(np.int64))
        ids = pa.nulls(len(hashes), pa.int64()) if docs is None else pa.array(docs)
        return pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64)), counts], names=["id", "anchor", "n"])

    def run(batches):
        for table in _by_key(batches, "bucket"):
            parts = []
            for known, hashes, docs, counts in zip(*(table.column(c).to_pylist() for c in ("known", "hashes", "docs", "counts")), strict=True):
                if known:
                    yield result(_values(docs, "<i8"), _values(hashes, "<u8"))
                else:
                    parts.append((_values(hashes, "<u8"), _values(docs, "<i8"), _values(counts, "<u4")))
            if not parts:
                continue
            hashes, docs, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((docs, hashes))
            hashes, docs, counts = hashes[order], docs[order], counts[order]
            listed = counts >= _SEVERAL
            first = _firsts(hashes)
            last = np.append(first[1:], len(hashes))
            total = np.add.reduceat((counts & (_SEVERAL - np.uint32(1))).astype(np.int64), first)
            shared = (docs[first] != docs[last - 1]) | np.logical_or.reduceat(listed, first)
            # A task that saw several documents has listed them.
            new = np.repeat(shared, last - first) & ~listed
            yield result(docs[new], hashes[new])
            long = total > group
            yield result(None, hashes[first][long], total[long])

    return dealt.mapInArrow(run, "id long, anchor long, n long")


_SUFFIX = "key long, id long, twin int, start int, left_words int, windows int, body binary"


def _suffixes(rows: DataFrame, long_anchors: np.ndarray) -> DataFrame:
    """The anchored suffixes of rows ``id, twin, text, anchors``, each with the
    windows around its anchor: ``windows`` of them, from word ``start`` on, the anchor
    being ``left_words`` after it. Rows without ``body`` are windows known to repeat,
    ``windows`` being their bits."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = [c.split()[0] for c in _SUFFIX.split(", ")]

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def of_text(raw, wanted):
        """Suffixes with a short prefix as columns; windows with a long one."""
        starts, ends, hashes = wordhash.words(raw)
        grams, low = anchors(hashes)
        if not len(low):
            return [], []
        at = np.flatnonzero(np.isin(low, wanted))
        inside = np.lib.stride_tricks.sliding_window_view(grams, STARTS)[at]
        place = at + inside.argmin(axis=1)
        is_long = np.isin(low[at], long_anchors)
        singles = at[is_long]
        names = [wordhash.runs(hashes ^ np.uint64(salt), WINDOW)[singles] for salt in (0, 0x5BF0_3635)]
        bodies = [raw[starts[i] : ends[i + WINDOW - 1]] for i in singles]
        at, place = at[~is_long], place[~is_long]
        first = _firsts(place) if len(at) else at
        count = np.append(first[1:], len(at)) - first
        s, p = at[first], place[first]
        short = [
            (int(k), int(a), int(b - a), int(n), raw[starts[a] : ends[a + n + WINDOW - 2]])
            for k, a, b, n in zip(grams[p].view(np.int64), s, p, count, strict=True)
        ]
        return short, list(zip(*names, singles, bodies, strict=True))

    def thinned(singles):
        """Of equal windows those of the smallest id go on, the others are repeats."""
        one, two, ids = (np.array([r[k] for r in singles], t) for k, t in ((0, np.uint64), (1, np.uint64), (2, np.int64)))
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        first = _firsts(one, two)
        low = np.repeat(ids[first], np.append(first[1:], len(ids)) - first)
        rows = []
        for k, i, smallest in zip(order, ids, low, strict=True):
            key, _, _, twin, start, body = singles[k]
            own = i == smallest
            rows.append((int(np.uint64(key).view(np.int64)) if own else int(i), int(i), twin, int(start), 0, 1, body if own else None))
        return batch_of(zip(*rows, strict=True))

    def run(batches):
        singles: list = []
        for batch in batches:
            for part in text_batches(iter([batch.select(["id", "text", "twin", "anchors"])])):
                rows = []
                for i, text, twin, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    short, windows = of_text((text or "").encode(), np.array(wanted, np.int64).view(np.uint64))
                    rows += [(k, i, twin, s, left, n, body) for k, s, left, n, body in short]
                    singles += [(a, b, i, twin, s, body) for a, b, s, body in windows]
                if rows:
                    yield batch_of(zip(*rows, strict=True))
                if len(singles) >= CHUNK:
                    yield thinned(singles)
                    singles = []
        if singles:
            yield thinned(singles)

    return rows.select("id", "text", "twin", "anchors").mapInArrow(run, _SUFFIX)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """A small number for each different combination of two small numbers."""
    a, b = keys
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeats(key: np.ndarray, ids: np.ndarray, left: np.ndarray, windows: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Per suffix the bits of its windows that also stand in a smaller document.

    Nodes are numbered level by level: a node at depth d is a node at depth d - 1
    and a word.
    """
    n = len(bodies)
    rank = np.unique(wordhash.words(b"\n".join(bodies))[2], return_inverse=True)[1]
    end = np.cumsum(windows + WINDOW - 1)
    begin = end - (windows + WINDOW - 1)
    anchor = begin + left
    alone = int(rank.max(initial=0)) + 1 + np.arange(n)  # in place of a word that is not there

    def word(at, inside):
        return np.where(inside, rank[np.clip(at, 0, len(rank) - 1)], alone)

    lefts = [np.zeros(n, np.int64)]
    for o in range(1, STARTS):
        lefts.append(_dense(lefts[-1], word(anchor - o, anchor - o >= begin)))
    node = np.unique(key, return_inverse=True)[1]
    bits = np.zeros(n, np.int64)
    for depth in range(1, WINDOW + 1):
        at = anchor + depth - 1
        node = _dense(node, word(at, at < end))
        o = WINDOW - depth
        if o >= STARTS:
            continue
        bit = left - o
        has = np.flatnonzero((bit >= 0) & (bit < windows))
        if not len(has):
            continue
        leaf = _dense(node[has], lefts[o][has])
        low = np.full(leaf.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, leaf, ids[has])
        late = has[ids[has] > low[leaf]]
        bits[late] |= 1 << bit[late]
    return bits


def _repeated(suffixes: DataFrame) -> DataFrame:
    """``id, twin, mark``: ``mark`` is a word's position times 256 and the bits of
    the windows that start there or up to seven words later and repeat."""

    def result(ids, twins, starts, bits):
        marks = starts.astype(np.int64) * 256 + bits
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(twins), pa.array(marks)], names=["id", "twin", "mark"])

    def run(batches):
        for table in _by_key(batches, "key", SUFFIXES):
            known = np.array([b is None for b in table.column("body").to_pylist()])
            key, ids, twin, start, left, windows = (table.column(c).to_numpy() for c in ("key", "id", "twin", "start", "left_words", "windows"))
            yield result(ids[known], twin[known], start[known], windows[known])
            own = np.flatnonzero(~known)
            if len(own):
                bodies = table.column("body").take(pa.array(own)).to_pylist()
                bits = repeats(key[own], ids[own], left[own].astype(np.int64), windows[own].astype(np.int64), bodies)
                own, bits = own[bits > 0], bits[bits > 0]
                yield result(ids[own], twin[own], start[own], bits)

    dealt = suffixes.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id long, twin int, mark long")


def covered(n_words: int, marks: list[int]) -> np.ndarray:
    """Which words stand in a repeated window."""
    packed = np.array(marks, np.int64)
    starts = (packed // 256)[:, None] + np.arange(8)
    starts = starts[(packed[:, None] % 256 >> np.arange(8) & 1).astype(bool)]
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _marked(docs: DataFrame, id_col: str, text_col: str, group: int) -> DataFrame:
    """``id, text, marks`` of every row; the texts are shuffled once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("twin", F.hash("text"))
    nameless = rows.filter("id IS NULL").select("id", "text", F.lit(None).cast("array<bigint>").alias("marks"))
    rows = rows.filter("id IS NOT NULL")
    found = written(shared_anchors(rows, group), "anchors")
    long = found.filter("id IS NULL").orderBy(F.desc("n"), "anchor").limit(MAX_LONG).select("anchor")
    long = np.sort(np.array([r.anchor for r in long.collect()], np.int64).view(np.uint64))
    wanted = found.filter("id IS NOT NULL").groupBy("id").agg(F.collect_list("anchor").alias("anchors"))
    # Both joins deal the same rows out by the same key: Spark reuses the exchange.
    suffixes = _suffixes(rows.join(wanted.hint("shuffle_hash"), "id"), long)
    marks = _repeated(suffixes).groupBy("id").agg(F.collect_list(F.struct("twin", "mark")).alias("twins"))
    joined = rows.join(marks.hint("shuffle_hash"), "id", "left")
    own = F.filter("twins", lambda t: t["twin"] == F.col("twin"))
    marked = joined.select("id", "text", F.transform(own, lambda t: t["mark"]).alias("marks"))
    return marked.unionByName(nameless)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per row: ``id_col, n_words, n_removed, kept_text``.

    A word goes if a window that covers it also starts in a document with a smaller
    id. ``kept_text`` are the other words, joined by one space, as bytes.
    """

    def run(batches):
        for batch in text_batches(batches):
            rows = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()  # bytes are split at ASCII white space
                gone = covered(len(words), marks) if marks else np.zeros(0, bool)
                kept = list(compress(words, (~gone).tolist())) if marks else words
                rows.append((len(words), int(gone.sum()), b" ".join(kept)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_removed", "kept_text"])

    marked = _marked(docs, id_col, text_col, group)
    out = marked.mapInArrow(run, "id long, n_words long, n_removed long, kept_text binary")
    return out.withColumnRenamed("id", id_col)


def maximal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``id_col, start, end``: the longest runs of words of each document that are
    covered by repeats, in words, the end exclusive."""

    def run(batches):
        for batch in text_batches(batches):
            rows = []
            for i, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if marks:
                    edges = np.flatnonzero(np.diff(covered(len(text.encode().split()), marks), prepend=False, append=False))
                    rows += [(i, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "start", "end"])

    out = _marked(docs, id_col, text_col, group).mapInArrow(run, "id long, start long, end long")
    return out.withColumnRenamed("id", id_col)


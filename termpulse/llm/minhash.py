"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian
verification, exact confirmation, connected components.

1. A document's set holds the hashes of its distinct runs of ``size`` words (A-Z
   in lower case; ``SHINGLE`` words unless the caller says otherwise). Documents of the same set form one class; from here on a class
   is one row, so copies cost nothing.
2. The signature of a class is cut into ``BANDS`` bands of ``ROWS`` values. Classes
   that agree on a band share a bucket. At the threshold of 0.8 a pair shares no
   bucket with a probability of (1 - 0.8^4)^32 = 5e-8.
3. First, each member of a bucket is compared with the smallest and the largest
   member. Then, in buckets whose members are not yet one component, the members of
   different components are compared in blocks of ``BLOCK``, inside the tasks: a
   bucket never meets in one task, and no pair leaves a task but a confirmed link
   that connects what was apart. A pair is judged in the first band it shares.
4. Judging is sequential: signatures are compared batch by batch, and a pair is
   dropped once the posterior probability that its similarity reaches the threshold
   falls below ``MISS``. With a uniform prior that probability after m matches in n
   values is P(Binomial(n + 1, threshold) <= m).
5. Survivors are confirmed on the full sets, from the texts. Links become
   components.

Nothing is capped: every pair that shares a bucket is judged, or its members are
already in one component.

Defined cases: a null or empty text, or one without words, has an empty set and is
linked with nothing; with fewer words than a shingle, the whole sequence is the
set; rows that repeat an id are one document; rows without an id are their own and
stay; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm import wordhash
from termpulse.llm.common import text_batches, written
from termpulse.llm.components import components
from termpulse.storage import broadcast_if_small

SHINGLE = 4
NUMERATOR, DENOMINATOR = 80, 100
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-7
BLOCK = 512

_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's set."""
    _, _, hashes = wordhash.words((text or "").encode().lower())
    if 0 < len(hashes) < size:
        # The sequence as a whole; its length keeps it apart from longer shingles.
        return wordhash.mix(wordhash.runs(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(wordhash.runs(hashes, size))


def signature(found: np.ndarray) -> np.ndarray:
    """Smallest value under each hash function, cut to 16 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):  # a block stays in the processor's cache
        block = np.multiply.outer(found[at : at + 256], _FACTORS) + _OFFSETS
        np.minimum(low, block.min(axis=0), out=low)
    # The lowest values share their leading bits: spread them before cutting.
    return (wordhash.mix(low) >> np.uint64(48)).astype("<u2")


@lru_cache(maxsize=8)
def fewest_matches(n: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, miss: float = MISS) -> int:
    """The fewest matches in ``n`` values with which a pair is not dropped."""
    t, below = numerator / denominator, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def survives(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of the pairs (rows of two signature tables) that are not dropped."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for at in range(0, HASHES, BATCH):
        part = slice(at, at + BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        stay = matches >= fewest_matches(at + BATCH)
        alive, matches = alive[stay], matches[stay]
    return alive


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return np.minimum(a, b) * DENOMINATOR >= np.maximum(a, b) * NUMERATOR


def bands_of(table: np.ndarray) -> np.ndarray:
    """Bucket of each signature in each band."""
    values = table.reshape(len(table), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
    for k in range(ROWS):
        total = wordhash.mix(total * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return total.view(np.int64)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """``id, n, high, low, sig`` of every row; ``high, low`` name the set in 128 bits."""

    def run(batches):
        for batch in text_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                name = [int(wordhash.mix(s ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (11, 29)]
                rows.append((len(s), *name, signature(s).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "high", "low", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, n long, high long, low long, sig binary")


def buckets_of(classes: DataFrame) -> DataFrame:
    """``class, band, bucket``: one row per class and band."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = bands_of(signatures(part.column(1)))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                band = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(band), pa.array(found.ravel())], names=["class", "band", "bucket"]
                )

    kind = classes.schema["class"].dataType.simpleString()
    return classes.select("class", "sig").mapInArrow(run, f"class {kind}, band int, bucket long")


def _judge_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs ``u, v`` those that survive the comparison of signatures."""
    side = classes.select("class", "n", "sig")
    joined = pairs.join(side.toDF("u", "n_u", "sig_u"), "u").join(side.toDF("v", "n_v", "sig_v"), "v")
    joined = joined.filter(F.least("n_u", "n_v") * DENOMINATOR >= F.greatest("n_u", "n_v") * NUMERATOR)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alive = survives(signatures(batch.column(2)), signatures(batch.column(3)))
                yield batch.select(["u", "v"]).take(pa.array(alive))

    kind = classes.schema["class"].dataType.simpleString()
    return joined.select("u", "v", "sig_u", "sig_v").mapInArrow(run, f"u {kind}, v {kind}")


def _groups(batches, key: str):
    """Rows of the same key, which stand together, as one batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for start, end in zip(edges, edges[1:], strict=False):
            if waiting and waiting[-1].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(start, end - start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _link_blocks(members: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Confirmed links ``u, v`` inside buckets, enough to connect their components.

    ``members`` has ``class, band, bucket, size, root``, ``texts`` has ``class,
    text``. A bucket is dealt into blocks; a task gets two of them, or one and
    itself. Survivors are confirmed there, the most similar first, and no pair is
    looked at whose members are connected by then.
    """
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), n_blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(
        F.xxhash64("bucket", first, second).alias("meeting"),
        (first == second).alias("alone"),
        (F.col("own") <= F.col("other")).alias("first"),
        "class",
        "root",
        "band",
    ).join(classes.select("class", "n", "sig").join(texts, "class"), "class")
    rows = rows.repartition("meeting").sortWithinPartitions("meeting")

    def run(batches):
        for group in _groups(batches, "meeting"):
            sig = signatures(group.column("sig").combine_chunks() if group.num_rows else group.column("sig"))
            n, root, first = (group.column(c).to_numpy() for c in ("n", "root", "first"))
            alone, band = group.column("alone")[0].as_py(), group.column("band")[0].as_py()
            found_u, found_v = [], []
            text, sets = group.column("text"), {}
            root = np.unique(root, return_inverse=True)[1]

            def set_of(k, text=text, sets=sets):
                if k not in sets:
                    sets[k] = shingles(text[k].as_py(), size)
                return sets[k]

            for i in np.flatnonzero(first) if not alone else range(len(n)):
                others = np.arange(i + 1, len(n)) if alone else np.flatnonzero(~first)
                others = others[(root[others] != root[i]) & similar_sizes(n[others], n[i])]
                left = np.broadcast_to(sig[i], (len(others), HASHES))
                others = others[survives(left, sig[others])]
                # The pair belongs to the first band that it shares.
                same = (sig[others] == sig[i]).reshape(len(others), BANDS, ROWS).all(axis=2)
                others = others[same.argmax(axis=1) == band]
                order = np.argsort(-(sig[others] == sig[i]).sum(axis=1), kind="stable")
                for j in others[order].tolist():
                    if root[j] != root[i] and linked(set_of(i), set_of(j)):
                        root[root == root[j]] = root[i]
                        found_u.append(i)
                        found_v.append(j)
            ids = group.column("class").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (found_u, found_v)], names=["u", "v"])

    kind = classes.schema["class"].dataType.simpleString()
    columns = rows.select("meeting", "alone", "first", "class", "root", "band", "n", "sig", "text")
    return columns.mapInArrow(run, f"u {kind}, v {kind}")


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(left) + len(right) - both)


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``class, text`` of the given classes, in the shared folder."""
    texts = docs.select(F.col(id_col).alias("class"), F.col(text_col).alias("text"))
    return written(texts.join(broadcast_if_small(ids), "class"), "texts")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """Of pairs ``u, v`` those whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    texts = texts_of(ids, docs, id_col, text_col)
    joined = pairs.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v")

    def run(batches):
        known: tuple = (None, None)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts at a time as Python strings
                part, keep = batch.slice(at, 64), []
                sides = (part.column(c).to_pylist() for c in ("v", "text_u", "text_v"))
                for i, (v, a, b) in enumerate(zip(*sides, strict=True)):
                    if known[0] != v:  # neighbours often share one side
                        known = (v, shingles(b, size))
                    if linked(shingles(a, size), known[1]):
                        keep.append(i)
                yield part.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    kind = pairs.schema["u"].dataType.simpleString()
    return joined.select("u", "v", "text_u", "text_v").mapInArrow(run, f"u {kind}, v {kind}")


def _linked(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Links ``u, v`` between classes, enough of them to connect every component."""
    placed = buckets_of(classes)
    shared = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("size"))
    members = written(placed.join(shared.filter("low < high"), "bucket"), "members")
    ends = F.explode(F.array("low", "high"))
    pairs = members.select(F.col("class").alias("u"), ends.alias("v")).filter("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    judged = written(_judge_pairs(pairs, classes), "pairs")
    links = written(confirm(judged, docs, id_col, text_col, size), "links")

    roots = components(links).toDF("class", "root")
    members = members.filter("size > 2").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    members = written(members.select("class", "band", "bucket", "size", "root"), "members")
    split = members.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one < other")
    apart = written(members.join(split.select("bucket"), "bucket"), "apart")
    texts = texts_of(apart.select("class").distinct(), docs, id_col, text_col)
    return links.unionByName(written(_link_blocks(apart, classes, texts, size), "links"))


def find_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row: ``id_col, n_shingles, component_id, kept``; sets of runs of ``size`` words.

    ``component_id`` is the smallest id that can be reached by links; the row with
    that id stays.
    """
    rows = written(sets_of(docs, id_col, text_col, size), "sets")
    named = rows.filter("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("high", "low", "n", "sig").agg(F.min("id").alias("class"))
    classes = written(classes, "classes")
    links = _linked(docs, classes, id_col, text_col, size)
    roots = components(links).toDF("class", "root")
    placed = classes.select("high", "low", "class").join(roots, "class", "left")
    placed = placed.select("high", "low", F.coalesce("root", "class").alias("root"))
    found = rows.select("id", "n", "high", "low").join(placed, ["high", "low"], "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        root.alias("component_id"),
        F.col("id").eqNullSafe(root).alias("kept"),
    )

"""Quality classification by importance resampling of hashed n-grams.

Two generative models over ``BINS`` bins of hashed words and word pairs: one of the
target (rows labelled good), one of the raw corpus (all rows). A document's log
importance weight is the sum over its n-grams of log target / raw. Drawing ``k``
documents without replacement in proportion to their weights is a top-k of
log weight + Gumbel noise, the noise being a hash of seed and id: every run and
every partitioning draws the same rows.

The counts are one vector of fixed size per task, summed in Spark. The cut at rank
k is found by histograms of the keys, each over the bin that holds the rank.

Words are runs without ASCII white space, A-Z in lower case. Defined cases: a null
or empty text has no n-grams and weight 0; labels with nulls are not good; of
several labels of a row one good one is enough; repeated rows have equal keys, and
rows that tie at the cut all stay; without good rows or without rows nothing is
drawn; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termpulse.llm import wordhash
from termpulse.llm.common import text_batches, written
from termpulse.storage import broadcast_if_small

BINS = 10_000
#: Added to every bin of both models.
SMOOTHING = 1.0
SEED = 1
HISTOGRAM = 1024
#: Keys of the bin with the cut that are looked at one by one.
LAST_KEYS = 1000


def bins_of(text: str | None) -> np.ndarray:
    _, _, hashes = wordhash.words((text or "").encode().lower())
    grams = np.concatenate([hashes, wordhash.runs(hashes, 2)])
    return (grams % np.uint64(BINS)).astype(np.int64)


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bin, of all rows and of the target."""

    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in text_batches(batches):
            for good, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(bins_of(text), minlength=BINS)
                total[0] += found
                if good:
                    total[1] += found
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, total[:, used])], names=["bin", "raw", "target"])

    found = rows.select("_good", "_text").mapInArrow(run, "bin long, raw long, target long")
    # At most BINS rows, whatever the input.
    sums = found.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BINS), np.zeros(BINS)
    for r in sums:
        raw[r.bin], target[r.bin] = r.raw, r.target
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    p, q = target + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def gumbel(seed: int, id_col: Column) -> Column:
    """Gumbel noise from a hash of seed and id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def cut(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, or None when there are fewer values."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k > n:
        return None
    above = 0
    while True:
        inside = keys.filter(F.col(column).between(low, high))
        width = (high - low) / HISTOGRAM
        if n <= LAST_KEYS or width == 0 or low + width == low:
            # Few values, or many equal ones: one row per value.
            counted = inside.groupBy(column).count().orderBy(F.desc(column))
            for value, count in counted.limit(LAST_KEYS).collect():
                above += count
                if above >= k:
                    return value
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(HISTOGRAM - 1))
        counted = inside.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for _, n, low, high in sorted(counted.collect(), reverse=True):
            if above + n >= k:
                break
            above += n


def weigh(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``log_weight`` of every row. ``good`` lists the ids of the target."""
    ids = good.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct().withColumn("_good", F.lit(True))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ratio = log_ratio(*_counts(rows.join(broadcast_if_small(ids), "_id", "left"))).astype(np.float64)

    def run(batches):
        for batch in text_batches(batches):
            scores = [float(ratio[bins_of(t)].sum()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "log_weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, log_weight double").withColumnRenamed("id", id_col)


def resample(
    docs: DataFrame, good: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """``id_col, log_weight, gumbel_key, kept``: ``share`` of all rows are drawn."""
    weights = weigh(docs, good, id_col, text_col)
    keys = written(weights.withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, F.col(id_col))), "weights")
    wanted = round(share * keys.count())
    level = cut(keys, "gumbel_key", wanted) if wanted and not good.isEmpty() else None
    kept = F.lit(False) if level is None else F.col("gumbel_key") >= level
    return keys.withColumn("kept", kept)


def labelled_share(labels: DataFrame, good: Column) -> float:
    """Share of labelled rows that are good; 0 without labels."""
    return labels.agg(F.avg(F.when(good, 1.0).otherwise(0.0))).first()[0] or 0.0

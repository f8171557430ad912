"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse.storage import broadcast_if_small, new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def let_workers_import(spark: SparkSession) -> None:
    """Give Python workers the path of this package, in case the session was not
    started with it (``--py-files`` or an installed package)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: no lineage, and no
    executor's disk is needed to read it again."""
    spark = df.sparkSession
    folder = new_folder(spark, label) + "/table"
    df.write.partitionBy(*partition_by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a null stays null.

    ``lower`` does the same, and faster, where all characters are ASCII.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def text_edges(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the column's buffer of bytes, and where the last ends."""
    if not len(texts):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_batches(
    batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut (id, text) batches so that each holds few rows and few bytes of text.

    A batch is at least one row, however long its text is; with more rows it holds
    ``size`` bytes at most.
    """
    for batch in batches:
        edges = text_edges(batch.column(1))
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(edges, edges[start] + size, "right")) - 1 - start
            step = max(1, min(rows, fits))
            yield batch.slice(start, step)
            start += step


def kept_rows(docs: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id ``verdicts`` does not turn down, all columns kept.

    ``verdicts`` has ``id_col`` and ``kept``. An id with several verdicts goes only
    if none of them keeps it; rows without an id stay. The texts are shuffled only
    if the ids that go are too many to broadcast.
    """
    gone = verdicts.groupBy(F.col(id_col).alias("_gone")).agg(F.max("kept").alias("_kept"))
    gone = broadcast_if_small(written(gone.filter("NOT _kept").select("_gone"), "gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")

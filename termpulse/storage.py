"""Shared scratch space and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termpulse import settings as S


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting, as in a test, gets a temporary
    folder of this machine; on a cluster other executors would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if shared:
        return shared
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="termpulse-")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the scratch folder, by its full URI; removed when the driver ends."""
    folder = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def stored(df: DataFrame, label: str) -> DataFrame:
    """A table written to the scratch folder and read back: what is built on it does not
    work it out again, also after an executor is lost."""
    spark = df.sparkSession
    folder = new_folder(spark, label) + "/table"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def row_width(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""

    def width_of(name: str, kind: str):
        if kind == "string":
            return F.coalesce(F.octet_length(name), F.lit(0))
        if kind == "array<string>":
            return F.coalesce(F.octet_length(F.concat_ws("", name)) + 8 * F.size(name), F.lit(0))
        return F.lit(8)

    return sum((width_of(c, t) for c, t in df.dtypes), F.lit(16))


def fits_broadcast(
    df: DataFrame, rows: int = S.BROADCAST_ROWS, size: int = S.BROADCAST_BYTES
) -> bool:
    """Measure whether a lookup table is small enough to broadcast.

    One aggregate over the table, a row per task; nothing of it is moved.
    """
    n, total = df.agg(F.count(F.lit(1)), F.sum(row_width(df))).first()
    return n <= rows and (total or 0) <= size


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table measured to be small; untouched otherwise."""
    return F.broadcast(df) if fits_broadcast(df) else df

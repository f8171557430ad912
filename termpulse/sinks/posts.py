"""Posts stored for many readers: a timestamp, and a folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.functions.dates import timestamp_of


def write_posts(posts: DataFrame, path: str, date_col: str = "date", mode: str = "errorifexists") -> None:
    """Write posts as parquet, partitioned by ``day``, with the parsed time in ``ts``.

    Dates are parsed once, here. ``filter_by_date(..., date_col="ts",
    day_col="day")`` then reads the folders of the range only. Posts without a
    readable date are in the folder of the null day. Days are dealt out in
    slices, so that no task writes all posts of a busy day.
    """
    ts = timestamp_of(posts, date_col)
    stored = posts.withColumns({"ts": ts.cast("timestamp_ntz"), "day": ts.cast("date")})
    stored.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)

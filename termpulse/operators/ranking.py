"""The first k rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termpulse import settings as S


def first_per_group(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank: str,
    spread: Sequence[str],
    sliced: bool = False,
) -> DataFrame:
    """Rows ranked 1..k in their group by ``order``, with the rank in ``rank``.

    Up to ``GROUP_LIMIT`` Spark cuts every group to k rows inside each task,
    before the shuffle (``WindowGroupLimit``). Beyond that it would send whole
    groups to one task each, so groups are first ranked in slices made from
    ``spread``, one per shuffle partition: the first k of a group are among the
    first k of its slices. ``sliced`` asks for this whatever k is, for groups that
    occur in every task, of which there may be very many.
    """
    if sliced or k > S.GROUP_LIMIT:
        slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(slices)))
        rows = _ranked(rows, [*group, "_slice"], order, k, rank).drop("_slice", rank)
    return _ranked(rows, group, order, k, rank)


def _ranked(rows, group, order, k, rank) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
